"""Statistics by ordered bits: exact, and the same for any partitioning."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataframe.operators import radix
from strataframe.operators.radix import from_bits, ordered_bits
from strataframe.operators.stats import column_stats


@given(st.lists(st.floats(), min_size=2, max_size=50))
@settings(max_examples=200, deadline=None)
def test_bits_order_as_the_values_do(values):
    x = np.array(values)
    bits = ordered_bits(x)
    for a, i in zip(values, bits.tolist()):
        assert from_bits(i) == a or math.isnan(a) and math.isnan(from_bits(i))
        for b, j in zip(values, bits.tolist()):
            if not (math.isnan(a) or math.isnan(b)):
                assert (a < b) == (i < j) and (a == b) == (i == j)
            else:
                assert (i < j) == (not math.isnan(a) and math.isnan(b))


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(6)
    n = 3000
    made = {"normal": rng.normal(size=n), "far": 1e6 + rng.normal(size=n) * 1e-2, "few": rng.integers(0, 3, n) / 7, "tiny": rng.normal(size=n) * 1e-300,
            "wide": 10.0 ** rng.uniform(-150, 150, n) * rng.choice([-1, 1], n), "one": np.full(n, -2.5), "zero": rng.choice([0.0, -0.0], n)}
    rows = [tuple(float(v[i]) if (i + k) % 11 or k == 5 else None for k, v in enumerate(made.values())) + (None, 3.0 if i == 17 else None) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [*made, "no.ne", "single"]))


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_agrees_with_numpy(wide, monkeypatch, few):
    # With no values few enough, every pass takes its 16 bits.
    monkeypatch.setattr(radix, "_FEW", few)
    got = {r["column"]: r for r in column_stats(wide, wide.columns).collect()}
    frame = wide.toPandas()
    for c in wide.columns:
        x, r = frame[c].dropna().to_numpy(), got[c]
        if not len(x):
            assert r["mean"] is None and r["q2"] is None and r["lambda"] == 1e50
            continue
        assert [r["q1"], r["q2"], r["q3"]] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist(), rel=1e-15, abs=1e-320)
        assert (r["min"], r["max"]) == (x.min(), x.max())
        assert r["mean"] == pytest.approx(x.mean(), rel=1e-12) and r["std_y"] == pytest.approx(np.sqrt(np.square(x).mean()), rel=1e-12)
        if len(x) > 1:
            assert r["std"] == pytest.approx(x.std(ddof=1), rel=1e-6)
        else:
            assert r["std"] is None and r["q1"] == r["q3"] == 3.0
        positive = x[x > 1e-7]
        assert r["lambda"] == pytest.approx(1 / positive.mean() if len(positive) else 1e50)


def test_partitions_do_not_matter(wide):
    exact = ("column", "q1", "q2", "q3", "min", "max")
    runs = [sorted(tuple(r[c] for c in exact) for r in column_stats(frame, wide.columns).collect())
            for frame in (wide, wide.repartition(7), wide.repartition(3, "normal").sortWithinPartitions("far"))]
    assert repr(runs[0]) == repr(runs[1]) == repr(runs[2])


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (float("-inf"),), (3.0,)], "x double")
    r = column_stats(df, ["x"]).first()
    assert (r["min"], r["q1"], r["q2"], r["q3"]) == (float("-inf"), 1.0, 2.0, 3.0) and math.isnan(r["max"])
    assert column_stats(df.limit(0), ["x"]).first()["q1"] is None


def test_zeros_are_alike(spark):
    rows = [spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1) for xs in ([-0.0, -0.0], [-0.0, 0.0], [0.0, -0.0])]
    for df in rows:
        r = column_stats(df, ["x"]).first()
        assert [repr(r[c]) for c in ("min", "q1", "q2", "q3", "max")] == ["0.0"] * 5
