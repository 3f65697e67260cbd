"""Per-column statistics over about a thousand columns, and data-quality reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.functions.scaling import STAT_NAMES
from strataframe.functions.text import array, quoted, string
from strataframe.operators.frame import union_all
from strataframe.operators.radix import radix_stats

# Row names of the wide statistics matrix, in the order of STAT_NAMES.
MATRIX_ROWS = ("mean", "std", "q1_4", "q2_4", "q3_4", "min", "max", "lambda", "std_y")
# Smallest value that counts as positive, and the mean where none does.
POSITIVE_FLOOR = 1e-7
NO_POSITIVE_MEAN = 1e-50
QUARTILES = (0.25, 0.5, 0.75)
# Spark hash-aggregates sketches up to 128 groups and sorts beyond. A chunk stays below.
CHUNK = 100
# Size of the sketch behind approximate quartiles: about 0.1 % error in rank.
SKETCH_K = 4096
# Guaranteed rank error (one part in ACCURACY) of the sketch that brackets exact quantiles.
ACCURACY = 10_000


def exp_rate(x: Column) -> Column:
    """Aggregate: one over the mean of the positive values."""
    positive = F.avg(F.when(x > POSITIVE_FLOOR, x))
    return F.lit(1.0) / F.coalesce(positive, F.lit(NO_POSITIVE_MEAN))


def rms(x: Column) -> Column:
    """Aggregate: root of the mean square."""
    return F.sqrt(F.avg(x * x))


def _positions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x) for every value, with the position of the column for its name.

    One array per row, exploded: the rows and the grouping key stay small.
    """
    values = array(f"CAST({quoted(c)} AS DOUBLE)" for c in columns)
    return df.selectExpr(f"posexplode({values}) AS (column, x)")


def _named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Positions under `column` back to names."""
    return df.withColumn("column", F.expr(f"element_at({array(map(string, names))}, column + 1)"))


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x) for every value of the given columns."""
    return _named(_positions(df, columns), columns)


def _moments(x: Column) -> list[Column]:
    return [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
            F.max(x).alias("max"), exp_rate(x).alias("lambda"), rms(x).alias("std_y")]


def long_stats(long: DataFrame, quantile: str = "approx", accuracy: int = ACCURACY) -> DataFrame:
    """Nine statistics per column of a (column, x) table.

    `approx` takes quartiles from a mergeable sketch in the same pass. `exact` interpolates linearly between
    the two neighbouring values and reads the input three times.
    """
    x = F.col("x")
    if quantile == "approx":
        sketch = F.kll_sketch_agg_double(x, SKETCH_K).alias("_sketch")
        stats = long.groupBy("column").agg(*_moments(x), sketch)
        ranks = F.array(*[F.lit(q) for q in QUARTILES])
        # A column without values has an empty sketch, which refuses to be asked.
        quartiles = F.when(F.kll_sketch_get_n_double("_sketch") > 0,
                           F.kll_sketch_get_quantile_double("_sketch", ranks))
        stats = stats.select("*", quartiles.alias("_q")).select(
            "*", *[F.col("_q")[i].alias(f"q{i + 1}") for i in range(3)])
    elif quantile == "exact":
        quartiles = (exact_quantiles(long, QUARTILES, accuracy).groupBy("column")
                     .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{i + 1}")
                            for i, p in enumerate(QUARTILES)]))
        stats = long.groupBy("column").agg(*_moments(x)).join(quartiles, "column", "left")
    else:
        raise ValueError(f"quantile is 'approx' or 'exact', not {quantile!r}")
    return stats.select("column", *STAT_NAMES)


def column_stats(df: DataFrame, columns: Sequence[str], quantile: str = "radix",
                 chunk: int = CHUNK, accuracy: int = ACCURACY) -> DataFrame:
    """Nine statistics per column.

    `radix`, the default, reads the columns three times as a rule and runs when called: its quartiles
    are exact and the same for any partitioning. `approx` and `exact` are lazy plans. All take `chunk`
    columns at a time; each chunk scans its own columns only, so a columnar source is read once a pass.
    """
    if quantile == "radix":
        return _radix_frame(df, list(columns), chunk)
    chunks = [list(columns[i:i + chunk]) for i in range(0, len(columns), chunk)]
    return union_all([
        _named(long_stats(_positions(df, names), quantile, accuracy), names) for names in chunks])


def _radix_frame(df: DataFrame, columns: list[str], chunk: int) -> DataFrame:
    moments, quartiles = radix_stats(df, columns, QUARTILES, POSITIVE_FLOOR, chunk)
    rows = []
    for i, name in enumerate(columns):
        m = moments.get(i)
        if m is None:
            # No values: only the rate is defined.
            rows.append((name, *[1.0 / NO_POSITIVE_MEAN if s == "lambda" else None for s in STAT_NAMES]))
            continue
        n = m["n"]
        rate = 1.0 / (m["positive_sum"] / m["positives"] if m["positives"] else NO_POSITIVE_MEAN)
        found = {"mean": m["mean"], "std": math.sqrt(m["m2"] / (n - 1)) if n > 1 else None, "min": m["low"], "max": m["high"], "lambda": rate,
                 "std_y": math.sqrt(m["squares"] / n), **{f"q{k}": quartiles[i, p] for k, p in enumerate(QUARTILES, start=1)}}
        rows.append((name, *[found[s] for s in STAT_NAMES]))
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"`{s}` double" for s in STAT_NAMES))


def level_stats(df: DataFrame, families: Sequence[str], quantile: str = "approx",
                accuracy: int = ACCURACY) -> DataFrame:
    """The same for every level of packed profiles; `f` at level i is column `f_i`."""
    parts = []
    for f in families:
        levels = df.selectExpr(f"posexplode(CAST({quoted(f)} AS ARRAY<DOUBLE>)) AS (column, x)")
        name = F.concat(F.lit(f"{f}_"), F.col("column").cast("string"))
        parts.append(long_stats(levels, quantile, accuracy).withColumn("column", name))
    return union_all(parts)


def exact_quantiles(long: DataFrame, probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(column, prob, value): linear interpolation between the neighbouring order statistics.

    A sketch gives each quantile a bracket that must hold it. A second pass counts the values
    below the bracket and groups equal values inside it, both combined before the shuffle, so a
    final sort sees about 6 / accuracy of a column's values and each distinct value once.
    """
    clean = long.filter(F.col("x").isNotNull())
    slack = 3.0 / accuracy
    edges = sorted({e for p in probs for e in (p - slack, p + slack) if 0.0 < e < 1.0})
    at = {e: i for i, e in enumerate(edges)}
    sketch = clean.groupBy("column").agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.percentile_approx("x", edges, accuracy).alias("edge"))

    def bracket(p: float) -> Column:
        # Short columns keep their full range: the sketch's slack is in rows there.
        wide = F.col("n") < accuracy
        low, high = p - slack, p + slack
        lo = F.col("edge")[at[low]] if low in at else F.col("lo")
        hi = F.col("edge")[at[high]] if high in at else F.col("hi")
        place = F.lit(p) * (F.col("n") - 1)
        return F.struct(
            F.lit(p).alias("prob"),
            F.when(wide, F.col("lo")).otherwise(lo).alias("lo"),
            F.when(wide, F.col("hi")).otherwise(hi).alias("hi"),
            F.floor(place).alias("rank"), (place - F.floor(place)).alias("part"))

    # One row per column and probability: bounded by the schema.
    brackets = sketch.select("column", F.inline(F.array(*[bracket(p) for p in probs])))
    key = ["column", "prob", "rank", "part"]
    counted = (
        clean.join(F.broadcast(brackets), "column")
        .filter(F.col("x") <= F.col("hi"))
        .select(*key, F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x"))
        .groupBy(*key, "x").agg(F.count("*").alias("n")))
    upto = F.sum("n").over(Window.partitionBy("column", "prob").orderBy(F.col("x").asc_nulls_first()))
    ranked = counted.withColumn("upto", upto)
    here, after = F.col("upto") > F.col("rank"), F.col("upto") > F.col("rank") + 1
    found = ranked.groupBy(*key).agg(
        F.max(F.when(F.col("x").isNull(), F.col("upto"))).alias("below"),
        F.min(F.when(here, F.col("x"))).alias("left"),
        F.min(F.when(after, F.col("x"))).alias("right"))
    lost = F.col("left").isNull() | (F.coalesce("below", F.lit(0)) > F.col("rank"))
    step = F.coalesce(F.col("right"), F.col("left")) - F.col("left")
    value = F.when(lost, F.raise_error(F.lit("quantile outside its bracket"))).otherwise(
        F.col("left") + F.col("part") * step)
    return found.select("column", "prob", value.alias("value"))


def stats_matrix(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nine rows by columns, with the row name under `stats`; joins any parts put in together."""
    arrow = stats.select("column", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_row"), F.lit(row).alias("stats"), F.col(name).alias("value"))
        for i, (row, name) in enumerate(zip(MATRIX_ROWS, STAT_NAMES))])))
    wide = arrow.groupBy("_row", "stats").pivot("column", list(columns)).agg(F.first("value"))
    return wide.orderBy("_row").drop("_row")


def stats_from_matrix(matrix: DataFrame) -> DataFrame:
    """The long form back from the nine-row form."""
    columns = [c for c in matrix.columns if c != "stats"]
    long = matrix.unpivot(["stats"], columns, "column", "value")
    wide = long.groupBy("column").pivot("stats", list(MATRIX_ROWS)).agg(F.first("value"))
    return wide.select("column", *[F.col(r).alias(n) for r, n in zip(MATRIX_ROWS, STAT_NAMES)])


def group_mean(df: DataFrame, key: str, col: str) -> DataFrame:
    """Mean of the non-null values per key."""
    return df.groupBy(key).agg(F.avg(col).alias(col))


def describe(df: DataFrame, col: str, accuracy: int = ACCURACY) -> DataFrame:
    """Typed summary of one column, quartiles exact."""
    x = df.select(F.lit(col).alias("column"), F.col(col).cast("double").alias("x"))
    basics = x.groupBy("column").agg(
        F.count("x").alias("count"),
        F.count_if(F.col("x").isNull()).alias("null_count"))
    return basics.join(long_stats(x, "exact", accuracy), "column").select(
        "column", "count", "null_count", "mean", "std", "min",
        F.col("q1").alias("p25"), F.col("q2").alias("p50"), F.col("q3").alias("p75"), "max")


def quality_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, null_count, nan_count, infinite_count) for each column, in one pass.

    Inside arrays of numbers every element counts; an array that is null counts as one null.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    conditions = ("{} IS NULL", "isnan({})", "abs({}) = double('Infinity')")

    def value(c: str) -> str:
        name, kind = quoted(c), types[c]
        if kind in ("double", "float"):
            counts = [f"IF({condition.format(name)}, 1L, 0L)" for condition in conditions]
        elif kind in ("array<double>", "array<float>"):
            counts = [f"CAST(size(filter({name}, v -> {condition.format('v')})) AS BIGINT)" for condition in conditions]
            counts = [f"IF({name} IS NULL, {empty}L, {count})" for count, empty in zip(counts, (1, 0, 0))]
        else:
            counts = [f"IF({name} IS NULL, 1L, 0L)", "0L", "0L"]
        return "struct({} AS n, {} AS a, {} AS i)".format(*counts)

    values = df.selectExpr(f"posexplode({array(map(value, columns))}) AS (position, x)")
    counts = values.groupBy("position").agg(
        F.count("*").alias("rows"), F.sum("x.n").alias("null_count"), F.sum("x.a").alias("nan_count"), F.sum("x.i").alias("infinite_count"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column string")
    return names.join(counts, "position", "left").orderBy("position").select(
        "column", *[F.coalesce(c, F.lit(0)).alias(c)
                    for c in ("rows", "null_count", "nan_count", "infinite_count")])


def is_bad(field: T.StructField) -> Column:
    """Whether a value, or any element of an array, is null, NaN or infinite."""
    def of(x: Column, kind: T.DataType) -> Column:
        finite = isinstance(kind, (T.DoubleType, T.FloatType))
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) if finite else x.isNull()

    x, kind = F.col(quoted(field.name)), field.dataType
    if isinstance(kind, T.ArrayType):
        return x.isNull() | F.exists(x, lambda v: of(v, kind.elementType))
    return of(x, kind)


def quality_check(df: DataFrame, expected_rows: int | None = None,
                  columns: Sequence[str] | None = None) -> None:
    """Raise unless the row count is as expected and no value is null, NaN or infinite."""
    missing = [c for c in columns or () if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    report = quality_report(df, columns).collect()
    rows = report[0]["rows"]
    if expected_rows is not None and rows != expected_rows:
        raise ValueError(f"expected {expected_rows} rows, found {rows}")
    bad = {r["column"]: (r["null_count"], r["nan_count"], r["infinite_count"]) for r in report
           if r["null_count"] or r["nan_count"] or r["infinite_count"]}
    if bad:
        raise ValueError(f"(null, nan, infinite) values in {bad}")
