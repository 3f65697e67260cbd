"""Column statistics whose quartiles do not depend on the order of merging: histograms of ordered bits.

The bits of a double, negative ones flipped, order as integers. A pass counts the values of each column
by the upper bits of that integer; every wanted rank lies in one of the counted buckets, and the next
pass counts only those buckets' values by more bits, until all bits are known. Counts are integers, so
sums of them are the same in any order. Values are taken by column from Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.text import array, quoted
from strataframe.operators.frame import union_all
from strataframe.session import scratch_path

_BITS = 16
_HELD = 2_000_000
#: With so few values left in the wanted buckets, a pass takes all bits that are left.
_FEW = 1 << 20
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)
_PARTS = ("column int, prefix long, n long, mean double, m2 double, low double, high double, "
          "positives long, positive_sum double, squares double")
_NAMES = [f.split()[0] for f in _PARTS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.float64(), pa.float64()]


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order: both zeros alike, NaN above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return bits ^ (bits >> 63 & _FLIP)


def from_bits(bits: int) -> float:
    value = np.array([bits], np.int64)
    return float((value ^ (value >> 63 & _FLIP)).view(np.float64)[0])


def _columns(arrays: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The non-null values of each position of equally long arrays."""
    flat = arrays.flatten()
    known = np.asarray(flat.is_valid()).reshape(-1, width).T if flat.null_count else None
    values = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, width).T)
    for i in range(width):
        yield values[i] if known is None else values[i][known[i]]


def _moments(x: np.ndarray, floor_at: float) -> tuple:
    mean = float(x.mean())
    positive = x[x > floor_at]
    nan = np.isnan(x)
    with np.errstate(over="ignore", invalid="ignore"):  # squares beyond all doubles are infinite, as in SQL
        squares = float(np.square(x - mean).sum()), float(np.square(x).sum())
    # Adding zero makes both zeros alike, as in the bits: which of them is the extreme would depend on the rows' order.
    high = float("nan") if nan.any() else float(x.max()) + 0.0
    low = float(x[~nan].min()) + 0.0 if not nan.all() else float("nan")
    return len(x), mean, squares[0], low, high, len(positive), float(positive.sum()), squares[1]


def _merged(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    step = b[1] - a[1]
    low = b[3] if np.isnan(a[3]) else a[3] if np.isnan(b[3]) else min(a[3], b[3])
    high = float("nan") if np.isnan(a[4]) or np.isnan(b[4]) else max(a[4], b[4])
    return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n, low, high, a[5] + b[5], a[6] + b[6], a[7] + b[7]


def _counted(batches: Iterator[pa.RecordBatch], first: int, width: int, shift: int, wanted: dict[int, np.ndarray] | None, parent_shift: int,
             floor_at: float) -> Iterator[pa.RecordBatch]:
    """Counts by prefix of each column's values, those of the wanted parents only; the first pass adds moments.

    A row holds the values of `width` columns, from the one in place `first` on.
    """
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    moments: dict[int, tuple] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        columns, rows = [[], [], []], 0
        for c, parts in held.items():
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            for own, x in zip(columns, (np.full(len(keys), c, np.int32), keys, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64))):
                own.append(x)
            rows += len(keys)
        if rows:
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in columns], *[pa.nulls(rows, t) for t in _TYPES[3:]]], names=_NAMES)
        own = [(c, None, *m) for c, m in moments.items()]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), _TYPES)], names=_NAMES)

    for batch in batches:
        for c, x in enumerate(_columns(batch.column(0), width), start=first):
            if not len(x) or wanted is not None and c not in wanted:
                continue
            if wanted is None:
                own = _moments(x, floor_at)
                moments[c] = _merged(moments[c], own) if c in moments else own
            bits = ordered_bits(x)
            if wanted is not None:
                parent, own = bits >> parent_shift, wanted[c]
                keep = parent == own[0]
                for w in own[1:]:
                    keep |= parent == w
                bits = bits[keep]
            # Few bits sort fast.
            prefix = (bits >> shift).astype(np.int16) if shift == 64 - _BITS else bits >> shift
            keys, counts = np.unique(prefix, return_counts=True)
            held.setdefault(c, []).append((keys.astype(np.int64), counts))
            size += len(keys)
        if size > _HELD:
            yield from flush()
            held, moments, size = {}, {}, 0
    yield from flush()


def _located(counts: DataFrame, targets: list[tuple[int, int, int]], parent_shift: int) -> list[tuple[int, int, int, int]]:
    """(column, rank asked in its parent, bucket, rank inside it) from (column, parent, rank) and the bucket's size."""
    spark = counts.sparkSession
    parent = F.lit(0).cast("long") if parent_shift >= 64 else F.shiftright("prefix", parent_shift)
    order = Window.partitionBy("column", "parent").orderBy("prefix")
    upto = counts.withColumn("parent", parent).withColumn("upto", F.sum("n").over(order))
    asked = spark.createDataFrame(targets, "column int, parent long, rank long")
    # A row for each column and rank: bounded by the schema.
    return upto.join(F.broadcast(asked), ["column", "parent"]).filter("upto - n <= rank AND rank < upto").select(
        "column", "parent", "rank", "prefix", (F.col("rank") - F.col("upto") + F.col("n")).alias("inside"), "n").collect()


def radix_stats(df: DataFrame, columns: Sequence[str], probs: Sequence[float], floor_at: float, chunk: int) -> tuple[dict[int, dict], dict[tuple[int, float], float]]:
    """Moments by column position, and linearly interpolated quantiles by (position, probability).

    Reads the columns three times, four where very many values share 32 bits. Nulls take no part, NaN
    is the largest value, columns without values have neither. What reaches the driver is bounded by
    the number of columns. Runs when called.
    """
    spark = df.sparkSession
    # A chunk of columns a scan: each reads its own columns only, and few enough for generated code.
    starts = range(0, len(columns), chunk)
    values = {i: df.select(F.expr(array(f"CAST({quoted(c)} AS DOUBLE)" for c in columns[i:i + chunk])).alias("v")) for i in starts}

    def counted(shift: int, wanted=None, parent_shift: int = 64) -> DataFrame:
        path = scratch_path(spark, "radix")
        union_all([v.mapInArrow(partial(_counted, first=i, width=min(chunk, len(columns) - i), shift=shift, wanted=wanted, parent_shift=parent_shift,
                                        floor_at=floor_at), _PARTS) for i, v in values.items()]).write.parquet(path)
        return spark.read.schema(_PARTS).parquet(path)

    shift = 64 - _BITS
    parts = counted(shift)
    moments = _finished(parts.filter("prefix IS NULL"))
    ranks = {(c, p): floor(p * (m["n"] - 1)) for c, m in moments.items() for p in probs}
    wanted_ranks = {c: sorted({r for (d, p), low in ranks.items() if d == c for r in (low, min(low + 1, moments[c]["n"] - 1))}) for c in moments}
    # Where each rank of a column is by now: its bucket, and its rank inside the bucket.
    place = {(c, r): (0, r) for c, rs in wanted_ranks.items() for r in rs}
    above = 64
    while place:
        sums = parts.filter("prefix IS NOT NULL").groupBy("column", "prefix").agg(F.sum("n").alias("n"))
        found = {(r["column"], r["parent"], r["rank"]): r for r in _located(sums, sorted({(c, b, r) for (c, _), (b, r) in place.items()}), above - shift if above < 64 else 64)}
        rows = {k: found[k[0], b, r] for k, (b, r) in place.items()}
        place = {k: (r["prefix"], r["inside"]) for k, r in rows.items()}
        if not shift:
            break
        left = sum({(r["column"], r["prefix"]): r["n"] for r in rows.values()}.values())
        above, shift = shift, 0 if left <= _FEW else max(0, shift - _BITS)
        wanted = {c: np.array(sorted({b for (d, _), (b, _) in place.items() if d == c})) for c in wanted_ranks}
        parts = counted(shift, wanted, above)
    quantiles = {}
    for (c, p), low in ranks.items():
        left, right = from_bits(place[c, low][0]), from_bits(place[c, min(low + 1, moments[c]["n"] - 1)][0])
        part = p * (moments[c]["n"] - 1) - low
        quantiles[c, p] = left + part * (right - left) if part else left
    return moments, quantiles


def _finished(parts: DataFrame) -> dict[int, dict]:
    """Moments of each column from those of its parts, by the parallel formula."""
    whole = parts.groupBy("column").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
    off = F.col("mean") - F.col("centre")
    rows = parts.join(whole, "column").groupBy("column", "all", "centre").agg(
        F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("positives").alias("positives"), F.sum("positive_sum").alias("positive_sum"), F.sum("squares").alias("squares")).collect()
    return {r["column"]: {"n": r["all"], "mean": r["centre"], **{k: r[k] for k in ("m2", "low", "high", "positives", "positive_sum", "squares")}}
            for r in rows}
