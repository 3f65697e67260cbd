"""Registry and the inputs that several queries share.

Inputs exist twice, as a Spark frame and as SQL text, because the oracle must derive them on its
own.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that summation order does not matter to a comparison."""
    return df.select(*[
        F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes])


# Wide samples: an id and four columns, two of which form the family `f`.
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("train_"), F.col("o_orderkey")).alias("sample_id"),
        (F.col("o_totalprice") / 10000).alias("f_0"),
        (F.col("o_custkey") / 1000).alias("f_1"),
        F.dayofyear("o_orderdate").cast("double").alias("day"),
        "o_orderkey")


SAMPLES = """
samples AS (
  SELECT 'train_' || o_orderkey AS sample_id, o_totalprice / 10000 AS f_0,
         o_custkey / 1000 AS f_1, CAST(dayofyear(o_orderdate) AS DOUBLE) AS day, o_orderkey
  FROM orders)"""

SAMPLE_COLUMNS = ("f_0", "f_1", "day")


def stats_sql(source: str, columns, name: str = "st") -> str:
    """One-row CTE with the nine statistics of each column, `<column>__<statistic>`."""
    parts = []
    for c in columns:
        parts.append(f"""
         avg({c}) AS {c}__mean, stddev_samp({c}) AS {c}__std,
         quantile_cont({c}, 0.25) AS {c}__q1, quantile_cont({c}, 0.5) AS {c}__q2,
         quantile_cont({c}, 0.75) AS {c}__q3, min({c}) AS {c}__min, max({c}) AS {c}__max,
         1 / coalesce(avg({c}) FILTER (WHERE {c} > 1e-7), 1e-50) AS {c}__lambda,
         sqrt(avg({c} * {c})) AS {c}__std_y""")
    return f"{name} AS (SELECT {','.join(parts)} FROM {source})"


# Labels and predictions of five runs. Run m5 is noise, and no run is any good at label y_4.
RUNS = ("m1", "m2", "m3", "m4", "m5")
RUN_TAGS = {"m1": "exp001a", "m2": "exp002a", "m3": "exp002a", "m4": "exp003b", "m5": "exp004c"}
LABELS = ("y_1", "y_2", "y_3", "y_4")


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("train_"), key).alias("sample_id"),
        (F.col("o_totalprice") / 10000).alias("y_1"),
        ((F.col("o_custkey") % 1000) / 100).alias("y_2"),
        (F.dayofyear("o_orderdate") / 100).alias("y_3"),
        (F.sin(key) / 10).alias("y_4"),
        key.alias("k"))


def predicted(run: str) -> dict[str, Column]:
    """Prediction of each label, from the columns of `label_table`."""
    m = RUNS.index(run) + 1
    preds = {}
    for j, label in enumerate(LABELS, start=1):
        if run == "m5":
            preds[label] = 3 * F.sin(F.col("k") * 12.9898 + j)
        elif label == "y_4":
            preds[label] = 2 * F.cos(F.col("k") * m)
        else:
            preds[label] = F.col(label) + 0.1 * (m * j % 5 + 1) * F.sin(F.col("k") * m + j)
    return preds


def predictions(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    return label_table(spark, sf_dir).select(
        "sample_id", *[value.alias(label) for label, value in predicted(run).items()])


LABEL_TABLE = """
labels_t AS (
  SELECT 'train_' || o_orderkey AS sample_id, o_totalprice / 10000 AS y_1,
         (o_custkey % 1000) / 100 AS y_2, dayofyear(o_orderdate) / 100 AS y_3,
         sin(o_orderkey) / 10 AS y_4, o_orderkey AS k
  FROM orders)"""


def predictions_sql(run: str) -> str:
    m = RUNS.index(run) + 1
    preds = []
    for j, label in enumerate(LABELS, start=1):
        if run == "m5":
            preds.append(f"3 * sin(k * CAST(12.9898 AS DOUBLE) + {j}) AS {label}")
        elif label == "y_4":
            preds.append(f"2 * cos(k * {m}) AS {label}")
        else:
            preds.append(f"{label} + CAST({0.1 * (m * j % 5 + 1)!r} AS DOUBLE) * sin(k * {m} + {j}) AS {label}")
    return f"{run} AS (SELECT sample_id, {', '.join(preds)} FROM labels_t)"


ALL_RUNS = ",\n".join([LABEL_TABLE, *[predictions_sql(run) for run in RUNS]])

PAIRS = ALL_RUNS + """,
pairs AS (
""" + "\nUNION ALL\n".join(
    f"SELECT '{run}' AS run, '{label}' AS \"column\", l.sample_id, l.{label} AS y, p.{label} AS pred "
    f"FROM labels_t l JOIN {run} p ON l.sample_id = p.sample_id"
    for run in RUNS for label in LABELS) + """),
r2 AS (
  SELECT run, "column",
         CASE WHEN var_pop(y) * count(*) <> 0
                THEN 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))
              WHEN sum((y - pred) * (y - pred)) = 0 THEN 1.0 ELSE 0.0 END AS r2
  FROM pairs GROUP BY run, "column")"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, sample_id, column, y, pred) of all runs, from one scan."""
    entries = [
        F.struct(F.lit(run).alias("run"), F.lit(label).alias("column"), F.col(label).alias("y"), value.alias("pred"))
        for run in RUNS for label, value in predicted(run).items()]
    return label_table(spark, sf_dir).select("sample_id", F.inline(F.array(*entries)))


# A weight per label, from the data: label y_2 weighs nothing.
def weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = label_table(spark, sf_dir).agg(
        F.avg("y_1").alias("y_1"), F.avg(F.col("y_2") * 0).alias("y_2"),
        F.avg("y_3").alias("y_3"), F.max("y_1").alias("y_4"))
    return sums.unpivot([], list(LABELS), "column", "weight")


WEIGHTS = """
weights AS (
  SELECT unnest(['y_1', 'y_2', 'y_3', 'y_4']) AS "column",
         unnest([avg(y_1), avg(y_2 * 0), avg(y_3), max(y_1)]) AS weight
  FROM labels_t)"""


# Profiles: one family of 64 levels, with a place and a time for each sample.
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "ts")
    v = F.col("embedding").cast("array<double>")
    return emb.join(events, "vec_id").select(
        F.col("vec_id").alias("sample_id"),
        F.col("label").cast("double").alias("s_a"),
        (F.col("vec_id") / 100).alias("s_b"),
        F.slice(v, 1, 32).alias("v_a"), F.slice(v, 33, 32).alias("v_b"),
        (F.col("label") * 2.5).alias("o_a"), F.transform(F.slice(v, 17, 32), lambda x: x * 2).alias("o_v"),
        F.col("label").cast("bigint").alias("location"),
        ((F.col("vec_id") % 181) - 90).cast("double").alias("lat"),
        (F.col("vec_id") % 360).cast("double").alias("lon"),
        F.lit(0).cast("bigint").alias("year"), F.month("ts").alias("month"),
        F.hour("ts").alias("hour"), F.dayofyear("ts").alias("day"))


PROFILES = """
profiles AS (
  SELECT vec_id AS sample_id, CAST(label AS DOUBLE) AS s_a, vec_id / 100 AS s_b,
         CAST(embedding[1:32] AS DOUBLE[]) AS v_a, CAST(embedding[33:64] AS DOUBLE[]) AS v_b,
         CAST(label * 2.5 AS DOUBLE) AS o_a,
         list_transform(CAST(embedding[17:48] AS DOUBLE[]), lambda x: x * 2) AS o_v,
         CAST((vec_id % 181) - 90 AS DOUBLE) AS lat, CAST(vec_id % 360 AS DOUBLE) AS lon,
         hour(ts) AS hour, dayofyear(ts) AS day
  FROM embeddings JOIN events ON event_id = vec_id)"""

TWO_PI = repr(2 * pi)
