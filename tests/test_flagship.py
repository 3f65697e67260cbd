"""The flagship on tables whose vectors share components."""

import datetime

import pytest
from pyspark.errors import PySparkException

from catalog.lookups import dataset, flagship


def tables(spark, folder, vectors):
    rows = [(i, v, i % 3) for i, v in vectors]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    times = [(i, datetime.datetime(2024, 1 + i % 12, 1 + i, 5)) for i in range(20)]
    spark.createDataFrame(times, "event_id long, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def vector(i, shared):
    return [shared if level == 2 else float((i * 7 + level * 3) % 13) for level in range(64)]


def test_vectors_may_share_a_component(spark, tmp_path):
    folder = tables(spark, tmp_path, [(i, vector(i, i // 2 / 4)) for i in range(10)])
    rows = {r["sample_id"]: r for r in flagship(spark, folder).collect()}
    assert {k: (r["location"], r["lat"], r["lon"], r["month"]) for k, r in rows.items()} == {
        f"train_{i}": (i % 3, i - 90, i, 1 + i % 12) for i in range(10)}
    assert dataset(spark, folder).count() == 640


@pytest.mark.parametrize("vectors", [[(1, vector(1, 0.5)), (1, vector(2, 1.0))], [(1, vector(1, 0.5)), (2, None)]])
def test_ambiguous_or_missing_samples_stop(spark, tmp_path, vectors):
    with pytest.raises(PySparkException, match="lookup"):
        flagship(spark, tables(spark, tmp_path, vectors)).collect()
