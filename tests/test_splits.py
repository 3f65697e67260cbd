import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from strataframe.operators.frame import prefix_sums, row_batches, scan_until
from strataframe.operators.splits import (
    assign_shard_exact, batch_plan, batches, holdout_split, shuffled_position, split_counts)
from strataframe.sources import shards
from strataframe.sources.shards import (
    _exact_places, export_shards, methods_from_table, methods_table, pick_shards, read_shards, scaled_row_count)


def ids(spark, n):
    return spark.range(n).select(F.concat(F.lit("train_"), "id").alias("sample_id"), "id")


def test_row_batches(spark):
    spans = row_batches(ids(spark, 25), "id", 10).select("batch_id", "start", "end").distinct().orderBy("batch_id")
    assert [tuple(r) for r in spans.collect()] == [(0, 0, 9), (1, 10, 19), (2, 20, 24)]


def test_scan_until_keeps_the_crossing_batch(spark):
    rows = row_batches(ids(spark, 100), "id", 10)
    assert scan_until(rows, "batch_id", 35).count() == 40
    assert scan_until(rows, "batch_id", 30).count() == 40
    assert scan_until(rows, "batch_id", 1000).count() == 100


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_prefix_sums_by_blocks(spark, blocks):
    days = [None, *(dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * i) for i in range(57))]
    rows = [(d, None if i % 9 == 4 else i * i % 13) for i, d in enumerate(days)]
    for kind in ("timestamp", "timestamp_ntz", "string", "double"):
        value = F.col("d").cast(kind) if kind != "double" else F.unix_micros(F.col("d").cast("timestamp")).cast("double")
        df = spark.createDataFrame(rows[::-1], "d timestamp_ntz, n long").select(value.alias("d"), "n").repartition(5)
        got = prefix_sums(df, "d", "n", blocks=blocks).orderBy("d").collect()
        assert [r["before"] for r in got] == [sum(n or 0 for _, n in rows[:i]) for i in range(len(rows))]
    assert prefix_sums(df.limit(0), "d", "n", blocks=blocks).collect() == []


def test_scan_until_orders_nothing_in_one_task(spark):
    plan = prefix_sums(ids(spark, 100).withColumn("n", F.lit(1)), "id", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan
    assert scan_until(ids(spark, 100).filter("id < 0"), "id", 10).count() == 0


def test_holdout_orders(spark):
    rows = row_batches(ids(spark, 120), "id", 10)

    def val(order):
        out = holdout_split(rows, 2, order).filter("split = 'val'")
        return sorted(r[0] for r in out.select("batch_id").distinct().collect())

    assert val("numeric") == [10, 11]
    assert val("lexicographic") == [8, 9]
    assert holdout_split(rows, 2).count() == 120


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 400), st.integers(1, 5), st.sampled_from([1, 7, 256, 100_003]))
def test_positions_are_a_permutation(spark, n, groups, pieces):
    rows = ids(spark, n).withColumn("g", F.col("id") % groups)
    placed = shuffled_position(rows, "sample_id", ["g"], n_pieces=pieces)
    by_group = {}
    for r in placed.collect():
        by_group.setdefault(r["g"], []).append((r["shuffle_key"], r["position"], r["group_rows"]))
    for found in by_group.values():
        found.sort()
        assert [p for _, p, _ in found] == list(range(len(found)))
        assert {size for _, _, size in found} == {len(found)}


def test_exact_shards_balance(spark):
    rows = row_batches(ids(spark, 1000), "id", 250)
    sizes = [r["count"] for r in assign_shard_exact(rows, "sample_id", "batch_id", 7).groupBy("batch_id", "shard").count().collect()]
    assert len(sizes) == 28 and max(sizes) - min(sizes) <= 1


def test_batches(spark):
    rows = ids(spark, 100).withColumn("shard", F.col("id") % 3)
    kept = batches(rows, "sample_id", "shard", 10, drop_last=True)
    assert {r["count"] for r in kept.groupBy("shard", "batch").count().collect()} == {10}
    assert kept.count() == 90
    assert batches(rows, "sample_id", "shard", 10, drop_last=False).count() == 100


def test_batch_plan(spark):
    counts = spark.createDataFrame([("train", 100), ("val", 101)], "split string, n long")
    plan = {r["split"]: (r["batches"], r["steps"]) for r in batch_plan(counts, 10, devices=2, epochs=3).collect()}
    assert plan == {"train": (10, 15), "val": (11, 15)}


def test_export(spark, tmp_path):
    n = 3000
    rows = holdout_split(row_batches(ids(spark, n), "id", 100), 5).select("sample_id", "id", "split")
    path = str(tmp_path / "shards")
    sizes = export_shards(rows, path, "sample_id", {"train": 4, "val": 2, "test": 1}, rows_per_file=200)
    assert sizes == {"train": 2500, "val": 500}
    back = spark.read.parquet(path)
    assert back.count() == n and back.select("sample_id").distinct().count() == n
    assert sorted(r["shard"] for r in back.filter("split = 'train'").select("shard").distinct().collect()) == [0, 1, 2, 3]
    # 2500 rows in 4 shards of 200-row files: four files a shard.
    files = back.filter("split = 'train'").select("shard", F.input_file_name().alias("f")).groupBy("shard").agg(
        F.countDistinct("f").alias("n")).collect()
    assert {r["n"] for r in files} == {4}
    # A second export leaves the first alone; rerunning the same seed gives the same shards.
    assert export_shards(rows.limit(10), path, "sample_id", {"train": 4, "val": 2}) == sizes
    again = str(tmp_path / "again")
    export_shards(rows, again, "sample_id", {"train": 4, "val": 2}, rows_per_file=200)
    a = {(r["sample_id"], r["split"], r["shard"]) for r in back.collect()}
    assert a == {(r["sample_id"], r["split"], r["shard"]) for r in spark.read.parquet(again).collect()}

    some = read_shards(spark, path, "train", 2, seed=1)
    assert some.select("shard").distinct().count() == 2
    assert "PartitionFilters: [isnotnull(split" in some._jdf.queryExecution().toString()
    assert pick_shards(read_shards(spark, path, "train"), 2, 1) == pick_shards(read_shards(spark, path, "train"), 2, 1)
    assert scaled_row_count(2500, 2, 4) == 1250


def test_export_needs_counts(spark, tmp_path):
    rows = ids(spark, 10).withColumn("split", F.lit("odd"))
    with pytest.raises(ValueError, match="odd"):
        export_shards(rows, str(tmp_path / "x"), "sample_id", {"train": 1})


def test_counts_and_methods(spark):
    rows = ids(spark, 10).withColumn("split", F.when(F.col("id") < 3, "val").otherwise("train"))
    assert {tuple(r) for r in split_counts(rows).collect()} == {("train", 7), ("val", 3)}
    methods = {"standard": ["b", "a"], "robust": [], "exp": None}
    assert methods_from_table(methods_table(spark, methods)) == {"standard": ["b", "a"]}


@pytest.mark.parametrize("rows_per_file", [37, 200, 100_000])
def test_exact_export(spark, tmp_path, rows_per_file):
    n = 2999
    rows = holdout_split(row_batches(ids(spark, n), "id", 100), 5).select("sample_id", "id", "split")
    path = str(tmp_path / "shards")
    sizes = export_shards(rows, path, "sample_id", {"train": 7, "val": 3}, rows_per_file=rows_per_file, balance="exact")
    back = spark.read.parquet(path)
    assert back.count() == n == sum(sizes.values()) and back.select("id").distinct().count() == n
    for split, shards in (("train", 7), ("val", 3)):
        found = [r["count"] for r in back.filter(F.col("split") == split).groupBy("shard").count().collect()]
        assert len(found) == shards and max(found) - min(found) <= 1
    # Shards hold the shuffled order in equal runs.
    digest = F.md5(F.concat(F.lit("42:"), "sample_id"))
    spans = back.filter("split = 'train'").groupBy("shard").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).orderBy("shard").collect()
    assert all(a["high"] < b["low"] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("balance", ["exact", "hash"])
def test_small_files_share_tasks(spark, tmp_path, monkeypatch, balance):
    rows = ids(spark, 2999).withColumn("split", F.when(F.col("id") >= 2900, "val").otherwise("train")).select("sample_id", "id", "split")
    found = {}
    for few in (1, 1 << 20):
        monkeypatch.setattr(shards, "FEW_TASKS", few)
        monkeypatch.setattr(shards, "TASK_ROWS", 500)
        path = str(tmp_path / f"{balance}{few}")
        place = shards._exact_places if balance == "exact" else shards._hash_places
        placed, parts = place(rows, "sample_id", {"train": 7, "val": 3}, {"train": 2900, "val": 99}, 42, 20)
        export_shards(rows, path, "sample_id", {"train": 7, "val": 3}, rows_per_file=20, balance=balance)
        back = spark.read.parquet(path)
        found[few] = (placed.rdd.getNumPartitions(), {(r["split"], r["shard"], r["id"]) for r in back.collect()})
        largest = back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
        assert few > 1 or largest <= 20
    assert found[1][0] == 6 and found[1 << 20][0] == parts > 140
    assert found[1][1] == found[1 << 20][1] and len(found[1][1]) == 2999


def test_exact_export_shuffles_rows_once(spark):
    rows = ids(spark, 2999).withColumn("split", F.lit("train"))
    placed, parts = _exact_places(rows, "sample_id", {"train": 4}, {"train": 2999}, 42, 200)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert parts == 16
    # One exchange of whole rows by range; the others belong to the counts of ranges, which are broadcast.
    wide = [line for line in plan.splitlines() if "Exchange" in line and "sample_id" not in line and "REPARTITION" in line]
    assert len(wide) == 1, plan
    assert "SortMergeJoin" not in plan
    with pytest.raises(ValueError, match="balance"):
        export_shards(rows, "unused", "sample_id", balance="even")
