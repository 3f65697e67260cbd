import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from strataframe.functions.profiles import (
    assemble_flat, assemble_sequential, flipped_diffs, level_mean, level_rows, output_layout, pack_families,
    profile_diffs, profile_features, profile_stats, stack_outputs, unpack_families)
from strataframe.schema import ProfileSchema


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame([("a", 2.0, [1.0, 4.0, 9.0])], "sample_id string, s double, v array<double>")


def test_diffs_and_stats(hand):
    v = F.col("v")
    row = hand.select(profile_diffs(v).alias("d"), flipped_diffs(v).alias("f"),
                      *[c.alias(n) for n, c in profile_stats(v).items()]).first()
    assert row["d"] == [3, 5] and row["f"] == [-5, -3]
    assert (row["min"], row["max"]) == (1, 9) and row["mean"] == pytest.approx(14 / 3)


def test_short_profiles(spark):
    df = spark.createDataFrame([([],), ([1.0],), (None,)], "v array<double>")
    rows = df.select(profile_diffs(F.col("v")), level_mean(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [([], None), ([], 1.0), (None, None)]


def test_feature_count(spark):
    vectors = [F.array(*[F.lit(float(i)) for i in range(60)]) for _ in range(9)]
    scalars = [F.lit(1.0)] * 16
    assert spark.range(1).select(F.size(profile_features(scalars, vectors))).first()[0] == 1105


def test_pack_out_of_order(spark):
    df = spark.createDataFrame([(10.0, 2.0, 0.0, 1.0)], "v_10 double, v_2 double, v_0 double, v_1 double")
    assert pack_families(df, ["v"]).first()["v"] == [0, 1, 2, 10]
    with pytest.raises(ValueError):
        pack_families(df, ["w"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(-1e6, 1e6), min_size=12, max_size=12), min_size=1, max_size=5))
def test_unpack_then_pack(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, v array<double>")
    back = pack_families(unpack_families(df, ["v"], 12), ["v"])
    assert [r["v"] for r in back.orderBy("id").collect()] == rows


def test_layouts(spark):
    schema = ProfileSchema(("s",), ("v", "w"), ("o",), ("p",), levels=2)
    df = spark.createDataFrame(
        [("a", 1.0, [2.0, 3.0], [4.0, 5.0], 6.0, [7.0, 8.0], 45.0, 90.0, 6, 183)],
        "sample_id string, s double, v array<double>, w array<double>, o double, p array<double>, "
        "lat double, lon double, hour int, day int")
    flat = assemble_flat(df, schema).first()
    assert flat["input"] == [1, 2, 3, 4, 5] and flat["labels"] == [6, 7, 8]
    assert flat["aux"] == pytest.approx([0.5, 0, 1, 0, 1, -1, 0], abs=1e-6)
    seq = assemble_sequential(df, schema, labels=False).first()
    assert seq["x_scalar"] == [1] and seq["x_vector"] == [[2, 3], [4, 5]]
    assert "labels" not in seq.asDict()


def test_levels_there_and_back(spark, hand):
    rows = level_rows(hand, "sample_id", ["s"], ["v"])
    assert [tuple(r) for r in rows.orderBy("level").collect()] == [
        ("a", 2, 0, 1), ("a", 2, 1, 4), ("a", 2, 2, 9)]
    shuffled = rows.orderBy(F.col("level").desc())
    out = output_layout(shuffled.withColumn("q", F.col("v") * 2), "sample_id", ["q"], ["v", "q"]).first()["outputs"]
    assert out == pytest.approx([28 / 3, 1, 4, 9, 2, 8, 18])
    twice = F.transform("v", lambda x: x * 2)
    stacked = hand.select(stack_outputs([F.col("v"), twice], [twice]).alias("o")).first()["o"]
    assert stacked == pytest.approx(out)
