"""Generating the processed tables: checks on the way, restarts, and never two scalings in one table."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataframe.plans import prepare
from strataframe.plans.prepare import between, generate_phase, statistics_phase
from strataframe.schema import ProfileSchema
from strataframe.sources.files import is_complete
from strataframe.sources.shards import methods_from_table

SMALL = ProfileSchema(in_scalars=("pbuf_ozone_2",), in_families=("state_t",), out_scalars=("y",), out_families=(), levels=2)
STANDARD = {"standard": ["pbuf_ozone_2", "state_t", "y"]}
MINMAX = {"minmax": ["pbuf_ozone_2", "state_t", "y"]}
N, SIZE = 60, 10


@pytest.fixture
def raw(spark, tmp_path):
    rng = np.random.default_rng(4)
    train = pd.DataFrame({"sample_id": [f"train_{i}" for i in range(N)], "pbuf_ozone_2": np.arange(N) / 8, "state_t_0": rng.normal(size=N),
                          "state_t_1": rng.normal(size=N), "y": rng.normal(size=N), "batch_id": np.arange(N) // SIZE})
    train["start"], train["end"] = train["batch_id"] * SIZE, (train["batch_id"] + 1) * SIZE
    test = train.head(7)[["sample_id", "pbuf_ozone_2", "state_t_0", "state_t_1"]].assign(sample_id=[f"test_{i}" for i in range(7)])
    lookup = pd.DataFrame({"pbuf_ozone_2": train["pbuf_ozone_2"], "location": np.arange(N), "timestamp": pd.Timestamp("2001-01-01 08:00"), "lat": 1.0, "lon": 2.0})
    base = str(tmp_path)
    spark.createDataFrame(train).write.parquet(f"{base}/raw_train")
    spark.createDataFrame(test).write.parquet(f"{base}/raw_test")
    statistics_phase(spark, base, SMALL, quantile="exact")
    return base, spark.createDataFrame(lookup)


def table(spark, base, name="processed_train"):
    return spark.read.parquet(f"{base}/v1/{name}").orderBy("sample_id").toPandas()


def files(base, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{base}/v1/{name}") for f in names if f.endswith(".parquet")}


def stop_at(monkeypatch, count):
    """The process dies instead of the write of that number."""
    write, calls = prepare.write_checked, []

    def dying(*args, **kwargs):
        calls.append(args[1])
        if len(calls) == count:
            raise KeyboardInterrupt
        write(*args, **kwargs)

    monkeypatch.setattr(prepare, "write_checked", dying)
    return calls


def test_layout_and_check_without_a_second_read(spark, raw, monkeypatch):
    base, lookup = raw
    monkeypatch.setattr(prepare, "quality_check", lambda df: pytest.fail("the output was read again"))
    generate_phase(spark, base, lookup, SMALL, STANDARD, "v1", rows_per_commit=20)
    got = table(spark, base)
    assert list(got.columns) == [*SMALL.packed_columns(), "batch_id", "start", "end"] and len(got) == N
    assert (got["start"] == got["batch_id"] * SIZE).all()
    assert len(table(spark, base, "processed_test")) == 7


def test_killed_between_train_and_test(spark, raw, monkeypatch):
    base, lookup = raw
    with monkeypatch.context() as m:
        stop_at(m, 4)
        with pytest.raises(KeyboardInterrupt):
            generate_phase(spark, base, lookup, SMALL, STANDARD, "v1", rows_per_commit=20)
    assert not is_complete(spark, f"{base}/v1/scaler_methods")
    before = files(base, "processed_train")
    with monkeypatch.context() as m:
        calls = stop_at(m, 99)
        generate_phase(spark, base, lookup, SMALL, STANDARD, "v1", rows_per_commit=20)
    assert calls == [f"{base}/v1/processed_test"] and files(base, "processed_train") == before
    assert is_complete(spark, f"{base}/v1/scaler_methods") and len(table(spark, base)) == N


def test_killed_between_batches_resumes_with_the_missing_ones(spark, raw, monkeypatch):
    base, lookup = raw
    with monkeypatch.context() as m:
        stop_at(m, 3)
        with pytest.raises(KeyboardInterrupt):
            generate_phase(spark, base, lookup, SMALL, STANDARD, "v1", rows_per_commit=20)
    before = files(base, "processed_train")
    assert table(spark, base)["batch_id"].nunique() == 4
    generate_phase(spark, base, lookup, SMALL, STANDARD, "v1", rows_per_commit=20)
    after = files(base, "processed_train")
    assert before.items() <= after.items() and len(table(spark, base)) == N
    generate_phase(spark, base, lookup, SMALL, STANDARD, "v2")
    pd.testing.assert_frame_equal(table(spark, base), spark.read.parquet(f"{base}/v2/processed_train").orderBy("sample_id").toPandas())


@pytest.mark.parametrize("at", [1, 2, 4])
def test_never_two_scalings(spark, raw, monkeypatch, at):
    base, lookup = raw
    generate_phase(spark, base, lookup, SMALL, STANDARD, "v1", rows_per_commit=20)
    with monkeypatch.context() as m:
        stop_at(m, at)
        with pytest.raises(KeyboardInterrupt):
            generate_phase(spark, base, lookup, SMALL, MINMAX, "v1", overwrite=True, rows_per_commit=20)
    # No sidecar tells of a scaling while the tables are in between, and whoever goes on gets one scaling.
    assert not is_complete(spark, f"{base}/v1/scaler_methods")
    generate_phase(spark, base, lookup, SMALL, STANDARD, "v1", rows_per_commit=20)
    assert list(methods_from_table(spark.read.parquet(f"{base}/v1/scaler_methods"))) == ["standard"]
    generate_phase(spark, base, lookup, SMALL, STANDARD, "v3")
    for name in ("processed_train", "processed_test"):
        pd.testing.assert_frame_equal(table(spark, base, name), spark.read.parquet(f"{base}/v3/{name}").orderBy("sample_id").toPandas())


def test_bad_values_and_lost_rows_fail(spark, raw):
    base, lookup = raw
    spark.read.parquet(f"{base}/raw_train").withColumn("y", F.when(F.col("sample_id") == "train_3", float("nan")).otherwise(F.col("y"))).write.parquet(f"{base}/bad/raw_train")
    for name in ("raw_test", "stats"):
        spark.read.parquet(f"{base}/{name}").write.parquet(f"{base}/bad/{name}")
    with pytest.raises(ValueError, match="y"):
        generate_phase(spark, f"{base}/bad", lookup, SMALL, STANDARD, "v1")
    assert not is_complete(spark, f"{base}/bad/v1/scaler_methods")
    with pytest.raises(ValueError, match="expected 9 rows, found 3"):
        prepare.write_checked(spark.range(3), f"{base}/short", 9)


def test_ranges_of_batches(spark):
    picked = spark.range(20).filter(between(F.col("id"), [0, 1, 2, 5, 9, 10]))
    assert [r["id"] for r in picked.collect()] == [0, 1, 2, 5, 9, 10]


def test_scattered_rows_are_gathered_by_batch(spark, raw):
    base, _ = raw
    rows = spark.read.parquet(f"{base}/raw_train")
    assert prepare.clustered(rows, "batch_id") is rows
    dealt = prepare.clustered(rows.repartition(4, "sample_id"), "batch_id")
    assert "REBALANCE" in dealt._jdf.queryExecution().executedPlan().toString()
