"""Projection, filter, union and ordering helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.scalar import in_time_slots
from strataframe.functions.text import project, quoted
from strataframe.schema import natural_key
from strataframe.session import scratch_path


def select_ordered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def exclude(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def suffix_all(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns})


def cast_floats(df: DataFrame) -> DataFrame:
    """Doubles, and only those, to single precision."""
    return project(df, {
        c: f"CAST({quoted(c)} AS FLOAT)" if t == "double" else quoted(c) for c, t in df.dtypes})


def with_literal(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def filter_time_slots(df: DataFrame, ts_col: str, hours: Sequence[int], minute: int = 0) -> DataFrame:
    return df.filter(in_time_slots(F.col(ts_col), hours, minute))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def sort_by_id(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Text order of the id. A range shuffle: call it only right before a sink."""
    return df.orderBy(id_col)


def natural_order(df: DataFrame, name_col: str) -> DataFrame:
    return df.orderBy(*natural_key(F.col(name_col)))


def row_batches(df: DataFrame, position: str, batch_size: int, n_rows: int | None = None) -> DataFrame:
    """Batches of `batch_size` consecutive positions, with first and last position of each.

    The position comes from the id, so no row has to know how many rows come before it. The last
    batch ends at the highest position there is; finding it scans that column once more unless
    `n_rows` is given.
    """
    batch = F.floor(F.col(position) / F.lit(batch_size))
    last = df.agg(F.max(position)).scalar() if n_rows is None else F.lit(n_rows - 1)
    return df.withColumns({
        "batch_id": batch,
        "start": batch * batch_size,
        "end": F.least((batch + 1) * batch_size - 1, last),
    })


def prefix_sums(df: DataFrame, order_col: str, value_col: str, name: str = "before", blocks: int = 200) -> DataFrame:
    """`df` with `name`, the sum of `value_col` over all rows that come earlier in order of `order_col`.

    Two levels: the order is cut into at most `blocks` ranges, sums run inside each, and the totals of
    the ranges before it are added, so that no task orders the whole table. A row's range depends on
    its value alone, so any cut gives the same sums. Nulls come first and null values count as zero;
    rows of equal order follow each other in any order. `df` is evaluated three times.
    """
    kind = df.schema[order_col].dataType
    cut = df.select(order_col).repartitionByRange(blocks, order_col).groupBy(F.spark_partition_id()).agg(F.min(order_col).alias("m"))
    starts = [F.lit(r["m"]).cast(kind) for r in cut.collect() if r["m"] is not None]
    block = F.size(F.filter(F.array(*starts), lambda start: start <= F.col(order_col))) if starts else F.lit(0)
    placed = df.withColumn("_block", block)
    totals = {r["_block"]: r["t"] or 0 for r in placed.groupBy("_block").agg(F.sum(value_col).alias("t")).collect()}
    before = list(accumulate((totals.get(i, 0) for i in range(len(starts))), initial=0))
    earlier = Window.partitionBy("_block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value_col).over(earlier), F.lit(0))
    return placed.withColumn(name, inside + F.array(*map(F.lit, before))[F.col("_block")]).drop("_block")


def scan_until(df: DataFrame, batch_col: str, max_rows: int) -> DataFrame:
    """Whole batches in order until more than `max_rows` rows are read; the last one is kept whole.

    The table of batch sizes is written once, and its prefix sums are made block by block; rows are
    never ordered. Rows without a batch count as the first one and are left out.
    """
    path = scratch_path(df.sparkSession, "sizes")
    df.groupBy(batch_col).agg(F.count("*").alias("_n")).write.parquet(path)
    sizes = df.sparkSession.read.parquet(path)
    kept = prefix_sums(sizes, batch_col, "_n", "_before").filter(F.col("_before") <= max_rows)
    # The kept batches come first in order, so the last of them is a filter that the scan can use.
    return df.filter(F.col(batch_col) <= kept.agg(F.max(batch_col)).scalar())
