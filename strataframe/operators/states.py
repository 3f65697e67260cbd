"""Column statistics kept by batch: mergeable states that are added to as batches arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.scaling import STAT_NAMES
from strataframe.functions.text import array, quoted, string
from strataframe.operators.frame import union_all
from strataframe.operators.stats import CHUNK, NO_POSITIVE_MEAN, POSITIVE_FLOOR, QUARTILES
from strataframe.session import hadoop_fs
from strataframe.sources.files import is_complete

# Size of the sketch in a state: about 0.7 % error in rank, some 15 kB for a full one.
STATE_SKETCH_K = 512
#: So many missing batches at most are listed by the driver.
MOST_NAMED = 1000
ADDED = "added-"


def batch_states(df: DataFrame, columns: Sequence[str], batch: str = "batch_id",
                 sketch_k: int = STATE_SKETCH_K, chunk: int = CHUNK) -> DataFrame:
    """(batch, column, n, mean, m2, positive_sum, positives, squares, low, high, sketch).

    A row per batch and column, also where a column of the batch holds no value (n is 0). `m2` is the
    sum of squares around the mean. `chunk` columns at a time, each from a scan of its own columns.
    """
    x = F.col("x")
    positive = F.when(x > POSITIVE_FLOOR, x)
    parts = []
    for i in range(0, len(columns), chunk):
        names = list(columns[i:i + chunk])
        values = array(f"CAST({quoted(c)} AS DOUBLE)" for c in names)
        long = df.selectExpr(f"{quoted(batch)} AS batch", f"posexplode({values}) AS (position, x)")
        states = long.groupBy("batch", "position").agg(
            F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"),
            F.coalesce(F.sum(positive), F.lit(0.0)).alias("positive_sum"), F.count(positive).alias("positives"),
            F.coalesce(F.sum(x * x), F.lit(0.0)).alias("squares"), F.min("x").alias("low"), F.max("x").alias("high"),
            F.kll_sketch_agg_double("x", sketch_k).alias("sketch"))
        name = F.expr(f"element_at({array(map(string, names))}, position + 1)")
        parts.append(states.withColumn("column", name).select(
            F.col("batch").alias(batch), "column", "n", "mean", "m2", "positive_sum", "positives", "squares", "low", "high", "sketch"))
    return union_all(parts)


def merge_states(states: DataFrame) -> DataFrame:
    """The nine statistics per column of all batches in `states`.

    Moments are exact up to rounding: squares around the batch means, plus the distance of those
    means from the whole, so that large means lose no digits. Quartiles are those of the merged
    sketches. The means of the whole are broadcast; they are one row per column.
    """
    whole = states.groupBy("column").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    merged = states.join(F.broadcast(whole), "column").groupBy("column").agg(
        F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"),
        F.sum("positive_sum").alias("positive_sum"), F.sum("positives").alias("positives"), F.sum("squares").alias("squares"),
        F.min("low").alias("min"), F.max("high").alias("max"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    ranks = F.array(*[F.lit(q) for q in QUARTILES])
    # A column without values has an empty sketch, which refuses to be asked.
    quartiles = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_sketch", ranks))
    positive = F.when(F.col("positives") > 0, F.col("positive_sum") / F.col("positives"))
    found = merged.withColumn("_q", quartiles).select(
        "column", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
        *[F.col("_q")[i].alias(f"q{i + 1}") for i in range(3)], "min", "max",
        (F.lit(1.0) / F.coalesce(positive, F.lit(NO_POSITIVE_MEAN))).alias("lambda"),
        F.when(F.col("n") > 0, F.sqrt(F.col("squares") / F.col("n"))).alias("std_y"))
    return found.select("column", *STAT_NAMES)


def _additions(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    """Folders of the additions that came to their end, and whether there are folders of single batches, as written once."""
    fs, folder = hadoop_fs(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = sorted(name for name in names if name.startswith(ADDED) and is_complete(spark, f"{path}/{name}"))
    return whole, any("=" in name for name in names)


def read_states(spark: SparkSession, path: str) -> DataFrame | None:
    """The states written so far, or None. Additions that were stopped do not count."""
    whole, single = _additions(spark, path)
    parts = [spark.read.parquet(*[f"{path}/{name}" for name in whole])] if whole else []
    if single:
        parts.append(spark.read.option("basePath", path).parquet(f"{path}/*=*"))
    return union_all(parts) if parts else None


def add_states(df: DataFrame, path: str, columns: Sequence[str], batch: str = "batch_id",
               sketch_k: int = STATE_SKETCH_K, chunk: int = CHUNK) -> int:
    """Adds the states of the batches of `df` that `path` does not hold yet; returns how many.

    Batches there already are left as they are. An addition is a folder that counts once it is whole, however
    many batches it holds, so a killed run begins its own addition again. Up to MOST_NAMED missing
    batches are named to the scan, so that no other is read beyond its number; of more, the scan is told the
    first and the last, and a join leaves out those between that are there. A table made for other columns is refused.
    """
    spark = df.sparkSession
    missing = df.select(batch).distinct()
    known = read_states(spark, path)
    if known is not None:
        held = {row["column"] for row in known.select("column").distinct().collect()}
        if held != set(columns):
            raise ValueError(f"{path} holds states of other columns: {sorted(held ^ set(columns))[:10]}")
        known = known.select(batch).distinct()
        missing = missing.join(known, batch, "left_anti")
    # Nulls come first.
    named = [row[batch] for row in missing.orderBy(batch).limit(MOST_NAMED + 1).collect()]
    if None in named:
        raise ValueError(f"rows without {batch}")
    if not named:
        return 0
    n = len(named)
    if n <= MOST_NAMED:
        df = df.filter(F.col(batch).isin(named))
    else:
        found = missing.agg(F.count("*").alias("n"), F.max(batch).alias("last")).first()
        n = found["n"]
        if known is not None:
            df = df.filter(F.col(batch).between(named[0], found["last"])).join(known, batch, "left_anti")
    whole, _ = _additions(spark, path)
    number = 1 + max((int(name.removeprefix(ADDED)) for name in whole), default=0)
    states = batch_states(df, columns, batch, sketch_k, chunk)
    states.repartition(F.col(batch)).write.mode("overwrite").parquet(f"{path}/{ADDED}{number:06d}")
    return n
