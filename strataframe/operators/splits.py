"""Deterministic splits, shuffles, shards and batches.

Everything is a function of the row's id and a seed, so a task that runs again after a lost
executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: Column, seed: int) -> Column:
    """Hex digest that orders rows at random but the same way every time."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_shard(digest: Column, n_shards: int) -> Column:
    """Shard from the first eight hex digits of a shuffle key."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(n_shards)


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Global permutation: a range shuffle on the digest, spilled by Spark as needed."""
    return (df.withColumn("shuffle_key", shuffle_key(F.col(key), seed))
            .orderBy("shuffle_key", key))


def assign_shard(df: DataFrame, key: str, n_shards: int, seed: int = 42) -> DataFrame:
    """Shard by hash: even in expectation, no shuffle."""
    return df.withColumn("shard", hash_shard(shuffle_key(F.col(key), seed), n_shards))


# Rows that one task sorts at a time.
PIECE_ROWS = 100_000


def shuffled_position(df: DataFrame, key: str, groups: Sequence[str], seed: int = 42,
                      n_pieces: int | None = None) -> DataFrame:
    """Exact 0-based place of each row in the shuffled order of its group, and the group's size.

    A group is cut into `n_pieces` ranges of the digest, any number of them; by default as many as
    keep a piece at about PIECE_ROWS rows if the whole table is one group. Rows are numbered inside a
    piece, and the sizes of the pieces before it are added, so that no task ever sorts a whole
    group. Rows and piece sizes are partitioned alike and meet without another shuffle.
    """
    if n_pieces is None:
        n_pieces = max(256, -(-df.count() // PIECE_ROWS))
    # The first 48 bits of the digest, in n_pieces equal ranges.
    width = -(-(1 << 48) // n_pieces)
    keyed = (df.withColumn("shuffle_key", shuffle_key(F.col(key), seed))
             .withColumn("_piece", F.expr(f"CAST(conv(substring(shuffle_key, 1, 12), 16, 10) AS BIGINT) div {width}L")))
    piece = [*groups, "_piece"]
    sizes = keyed.groupBy(*piece).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups)
    offsets = sizes.select(
        *piece,
        (F.sum("_n").over(whole.orderBy("_piece")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("group_rows"))
    rank = F.row_number().over(Window.partitionBy(*piece).orderBy("shuffle_key", key))
    placed = keyed.withColumn("_rank", rank).join(offsets, piece)
    return placed.select(*df.columns, "shuffle_key", "group_rows",
                         (F.col("_before") + F.col("_rank") - 1).alias("position"))


def assign_shard_exact(df: DataFrame, key: str, batch: str, n_shards: int, seed: int = 42) -> DataFrame:
    """Round-robin over the shuffled rows of each batch: shard sizes differ by one at most."""
    placed = shuffled_position(df, key, [batch], seed, n_pieces=256)
    return placed.select(*df.columns, (F.col("position") % n_shards).alias("shard"))


def batches(df: DataFrame, key: str, shard: str, batch_size: int, drop_last: bool,
            seed: int = 42) -> DataFrame:
    """Batch number inside each shard, in shuffled order; the short last batch can be dropped."""
    placed = shuffled_position(df, key, [shard], seed)
    placed = placed.withColumn("batch", F.floor(F.col("position") / batch_size))
    if drop_last:
        placed = placed.filter(F.col("batch") < F.floor(F.col("group_rows") / batch_size))
    return placed.select(*df.columns, "batch", "position")


def batch_name(start: Column, end: Column) -> Column:
    """Name of a batch file; its text order is not the order of the numbers."""
    return F.concat(start.cast("string"), F.lit("_"), end.cast("string"))


def holdout_split(df: DataFrame, num_val: int, order: str = "numeric", batch: str = "batch_id",
                  start: str = "start", end: str = "end") -> DataFrame:
    """Last `num_val` batches are `val`, the others `train`, by number or by batch name.

    The list of validation batches has `num_val` rows, whatever the input.
    """
    if order not in ("numeric", "lexicographic"):
        raise ValueError(f"order is 'numeric' or 'lexicographic', not {order!r}")
    ids = df.select(batch, start, end).distinct()
    last = F.col(batch) if order == "numeric" else batch_name(F.col(start), F.col(end))
    val = ids.orderBy(last.desc()).limit(num_val).select(batch, F.lit("val").alias("split"))
    joined = df.join(F.broadcast(val), batch, "left")
    return joined.select(*df.columns, F.coalesce("split", F.lit("train")).alias("split"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def batch_plan(counts: DataFrame, batch_size: int, devices: int = 1, accumulate: int = 1,
               epochs: int = 1, drop_last: Sequence[str] = ("train",)) -> DataFrame:
    """Batches per epoch and optimiser steps for each split."""
    full = F.floor(F.col("n") / batch_size)
    whole = F.ceil(F.col("n") / batch_size)
    per_epoch = F.floor(F.floor(full / devices) / accumulate)
    return counts.select(
        "split", "n",
        F.when(F.col("split").isin(list(drop_last)), full).otherwise(whole).alias("batches"),
        (per_epoch * epochs).alias("steps"))
