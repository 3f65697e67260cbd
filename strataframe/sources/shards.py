"""Shuffled training shards as Parquet partitions, and the small sidecar tables beside them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.operators.splits import hash_shard, shuffle_key, split_counts
from strataframe.sources.files import is_complete, write_parquet

# Shards per split.
SHARDS = {"train": 100, "val": 5, "test": 1}
# Ranges of the shuffle key that are counted at most, over all splits: their counts are broadcast.
MOST_RANGES = 1 << 20
# Small files share a task: above FEW_TASKS tasks, there is none for fewer than TASK_ROWS rows, as each sends its
# metrics to the driver.
FEW_TASKS, TASK_ROWS = 256, 200_000


def export_shards(df: DataFrame, path: str, id_col: str, shards: Mapping[str, int] = SHARDS,
                  seed: int = 42, shuffled: Iterable[str] = ("train",),
                  rows_per_file: int = 200_000, if_exists: str = "skip",
                  balance: str = "hash") -> dict[str, int]:
    """Write `df` (with a column `split`) below split=/shard= folders; returns rows per split.

    One shuffle. A shard is cut into as many files as its row count needs, so no task holds a
    whole shard of more rows than a task takes; within a shard the files and their rows follow the shuffle
    key. Many small files are written by fewer tasks, each for neighbouring ones. Splits that are not
    shuffled are ordered by id inside each file.

    `balance="hash"` places a row by the hash of its id, so shards are even in expectation.
    `balance="exact"` cuts the shuffled order of a split into equal runs, so that its shards differ by
    one row at most: ranges of the key are counted on ids alone, at most MOST_RANGES of them.
    """
    if balance not in ("hash", "exact"):
        raise ValueError(f"balance is 'hash' or 'exact', not {balance!r}")
    spark = df.sparkSession
    if if_exists == "skip" and is_complete(spark, path):
        counts = spark.read.parquet(path).groupBy("split").count()
        return {row["split"]: row["count"] for row in counts.collect()}
    sizes = {row["split"]: row["n"] for row in split_counts(df).collect()}
    unknown = set(sizes) - set(shards)
    if unknown:
        raise ValueError(f"no shard count given for splits {sorted(map(str, unknown))}")

    shuffled = set(shuffled)
    place = _exact_places if balance == "exact" else _hash_places
    placed, n_parts = place(df, id_col, shards, sizes, seed, rows_per_file)
    # A task of one part writes it whole; one of several cuts them again.
    most_rows = rows_per_file if _tasks(n_parts, sizes) < n_parts else 0
    order = F.when(F.col("split").isin(sorted(shuffled)), F.substring(F.col("_key"), *ORDER_DIGITS[balance]))
    placed = (placed.withColumn("_order", F.coalesce(order, F.col(id_col).cast("string")))
              .sortWithinPartitions("split", "shard", "_order")
              .select(*[c for c in df.columns if c != "split"], "split", "shard"))
    write_parquet(placed, path, "overwrite", ("split", "shard"), dictionary=False, rows_per_file=most_rows)
    return sizes


# First digit and number of the digits of the shuffle key that order the rows inside a shard.
ORDER_DIGITS = {"hash": (9, 24), "exact": (1, 32)}


def _files(size: int, n_shards: int, rows_per_file: int) -> int:
    return max(1, ceil(size / n_shards / rows_per_file))


def _tasks(n_parts: int, sizes: Mapping[str, int]) -> int:
    return max(1, min(n_parts, max(FEW_TASKS, ceil(sum(sizes.values()) / TASK_ROWS))))


def _by_task(df: DataFrame, n_parts: int, sizes: Mapping[str, int]) -> DataFrame:
    """Rows shuffled by `_part`, each task with a run of parts, whose number is under `_task`."""
    n_tasks = _tasks(n_parts, sizes)
    task = F.expr(f"CAST(CAST(_part AS BIGINT) * {n_tasks} div {max(1, n_parts)} AS INT)")
    return df.withColumn("_task", task).repartitionById(n_tasks, F.col("_task"))


def _hash_places(df: DataFrame, id_col: str, shards: Mapping[str, int], sizes: Mapping[str, int], seed: int,
                 rows_per_file: int) -> tuple[DataFrame, int]:
    """Rows with `shard` and `_key`, partitioned by runs of files, and the number of files."""
    key = shuffle_key(F.col(id_col), seed)
    shard = part = F.lit(None)
    offset = 0
    for split, n_shards in shards.items():
        if split not in sizes:
            continue
        files = _files(sizes[split], n_shards, rows_per_file)
        here = F.col("split") == split
        shard_id = hash_shard(key, n_shards)
        # Hex digits 9-16 order the rows inside a shard; their range also picks the file.
        piece = F.floor(F.conv(F.substring(key, 9, 8), 16, 10).cast("double") * files / 2.0**32)
        shard = F.when(here, shard_id.cast("int")).otherwise(shard)
        part = F.when(here, (F.lit(offset) + shard_id * files + piece).cast("int")).otherwise(part)
        offset += n_shards * files
    placed = df.withColumns({"shard": shard, "_part": part, "_key": key})
    return _by_task(placed, offset, sizes), offset


def _exact_places(df: DataFrame, id_col: str, shards: Mapping[str, int], sizes: Mapping[str, int], seed: int,
                  rows_per_file: int) -> tuple[DataFrame, int]:
    """The same by position: rows shuffle to their range of the key, where their rank is added to the counts before it."""
    key = shuffle_key(F.col(id_col), seed)
    part = F.lit(None)
    first, last = {}, 0
    for split, n_shards in shards.items():
        if split not in sizes:
            continue
        ranges = min(n_shards * _files(sizes[split], n_shards, rows_per_file), MOST_RANGES // len(sizes))
        width = -(-(1 << 48) // ranges)
        # Both are whole numbers below 2^49, so the floor of their quotient is exact.
        at = F.floor(F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / width)
        part = F.when(F.col("split") == split, (F.lit(last) + at).cast("int")).otherwise(part)
        first[split] = last
        last += ranges
    counts = df.select("split", id_col).select("split", part.alias("_part")).groupBy("split", "_part").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("split").orderBy("_part"))
    before = counts.select("_part", (upto - F.col("_n")).alias("_before"))

    def per_split(values: Mapping[str, int]) -> Column:
        chosen = F.lit(None).cast("long")
        for split, value in values.items():
            chosen = F.when(F.col("split") == split, F.lit(value).cast("long")).otherwise(chosen)
        return chosen

    rank = F.row_number().over(Window.partitionBy("_task", "_part").orderBy("_key", id_col))
    ranked = _by_task(df.withColumns({"_part": part, "_key": key}), last, sizes).withColumn("_rank", rank)
    position = F.col("_before") + F.col("_rank") - 1
    shard = F.expr("_position * _shards div _rows").cast("int")
    placed = ranked.join(F.broadcast(before), "_part").withColumns({
        "_position": position, "_shards": per_split({s: shards[s] for s in first}), "_rows": per_split({s: sizes[s] for s in first})})
    return placed.withColumn("shard", shard), last


def read_shards(spark: SparkSession, path: str, split: str, n_shards: int | None = None,
                seed: int = 42) -> DataFrame:
    """Rows of one split, or of `n_shards` of its shards picked by a seeded hash.

    The pick becomes a literal list, so the scan prunes every other folder.
    """
    rows = spark.read.parquet(path).filter(F.col("split") == split)
    if n_shards is None:
        return rows
    return rows.filter(F.col("shard").isin(pick_shards(rows, n_shards, seed)))


def pick_shards(rows: DataFrame, n_shards: int, seed: int) -> list[int]:
    """At most `n_shards` shard ids without replacement."""
    ids = rows.select("shard").distinct()
    picked = ids.orderBy(shuffle_key(F.col("shard"), seed), "shard").limit(n_shards)
    return [row["shard"] for row in picked.collect()]


def scaled_row_count(n_rows: int, n_picked: int, n_shards: int) -> int:
    """Expected rows of a subset of shards."""
    return int(n_rows * n_picked / n_shards)


def save_manifest(df: DataFrame, path: str) -> None:
    """A small sidecar table (rows per split, methods per column, R2 per column, broken columns)."""
    write_parquet(df.repartition(1), path, if_exists="overwrite")


def methods_table(spark: SparkSession, methods: Mapping[str, Iterable[str] | None]) -> DataFrame:
    """Scaler methods as (method, position, column)."""
    rows = [(method, i, name) for method, names in methods.items()
            for i, name in enumerate(names or ())]
    return spark.createDataFrame(rows, "method string, position int, column string")


def methods_from_table(df: DataFrame) -> dict[str, list[str]]:
    methods: dict[str, list[str]] = {}
    for row in df.orderBy("method", "position").collect():
        methods.setdefault(row["method"], []).append(row["column"])
    return methods
