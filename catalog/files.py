"""Scans and sinks. Each query writes its input to the shared scratch folder first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from catalog.registry import LABELS, PAIRS, RUN_TAGS, RUNS, pairs, predictions, query, rounded, table
from strataframe.operators.metrics import r2_by_column
from strataframe.operators.frame import row_batches, scan_until
from strataframe.session import scratch_path
from strataframe.sources.files import (
    csv_to_parquet, first_row_long, header, ingest_csv, scan_columns, scan_parquet, write_csv,
    write_parquet)
from strataframe.sources.lookups import load_lookup
from strataframe.sources.runs import load_predictions, load_scores, long_predictions

RAW = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("cust", T.DoubleType())])
RAW_SQL = """SELECT 'train_' || o_orderkey AS sample_id, o_totalprice AS price,
                    CAST(o_custkey AS DOUBLE) AS cust FROM orders"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("train_"), F.col("o_orderkey")).alias("sample_id"),
        F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))


def _raw_csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = scratch_path(spark, name)
    write_csv(_raw(spark, sf_dir), path, RAW.names)
    return path


@query("csv_ingest", RAW_SQL)
def csv_ingest(spark, sf_dir):
    return ingest_csv(spark, _raw_csv(spark, sf_dir, "csv_ingest"), RAW)


@query("csv_to_parquet", RAW_SQL)
def convert(spark, sf_dir):
    out = scratch_path(spark, "converted")
    csv_to_parquet(spark, _raw_csv(spark, sf_dir, "to_convert"), out, RAW)
    return scan_parquet(spark, out)


@query("scan_columns", """SELECT 'train_' || o_orderkey AS sample_id,
                                 CAST(o_custkey AS DOUBLE) AS cust FROM orders""")
def columns(spark, sf_dir):
    return scan_columns(spark, _raw_csv(spark, sf_dir, "scan_columns"), RAW, ["sample_id", "cust"])


@query("csv_roundtrip", """SELECT CAST(o_custkey AS DOUBLE) AS cust,
                                  'train_' || o_orderkey AS sample_id FROM orders""")
def roundtrip(spark, sf_dir):
    """Column order comes from the header of the file itself."""
    path = scratch_path(spark, "roundtrip")
    write_csv(_raw(spark, sf_dir), path, ["cust", "sample_id"])
    names = header(spark, path)
    schema = T.StructType([RAW[name] for name in names])
    return ingest_csv(spark, path, schema)


@query("weight_row_long", """
WITH w AS (SELECT o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS cust
           FROM orders ORDER BY o_orderkey LIMIT 1)
SELECT 'price' AS "column", price AS weight FROM w
UNION ALL SELECT 'cust', cust FROM w""")
def weight_row(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    return first_row_long(wide, "o_orderkey", order=["o_orderkey"])


@query("scan_parquet_cols",
       "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def parquet_columns(spark, sf_dir):
    return scan_parquet(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet",
                        ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])


@query("row_batches", """
SELECT o_orderkey, o_totalprice, o_orderkey // 1000 AS batch_id, o_orderkey // 1000 * 1000 AS start,
       least((o_orderkey // 1000 + 1) * 1000 - 1, (SELECT max(o_orderkey) FROM orders)) AS "end"
FROM orders""")
def batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return row_batches(orders, "o_orderkey", 1000)


@query("scan_until", """
WITH sizes AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1),
totals AS (SELECT d, sum(n) OVER (ORDER BY d) - n AS before FROM sizes)
SELECT event_id, value FROM events JOIN totals ON CAST(ts AS DATE) = d
WHERE before <= (SELECT count(*) // 2 FROM events)""")
def until(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return scan_until(events, "d", events.count() // 2).select("event_id", "value")


@query("write_skip_existing", """
SELECT 'skip' AS mode, c_custkey AS id, c_acctbal AS balance FROM customer
UNION ALL SELECT 'overwrite', s_suppkey, s_acctbal FROM supplier""")
def skip_existing(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    second = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    kept, replaced = scratch_path(spark, "kept"), scratch_path(spark, "replaced")
    for path in (kept, replaced):
        write_parquet(first, path, "skip")
    write_parquet(second, kept, "skip")
    write_parquet(second, replaced, "overwrite")
    return (scan_parquet(spark, kept).select(F.lit("skip").alias("mode"), "id", "balance")
            .unionByName(scan_parquet(spark, replaced).select(F.lit("overwrite").alias("mode"), "id", "balance")))


@query("load_lookup", """
SELECT o_totalprice AS price_key, o_custkey % 384 AS location, o_orderdate AS "timestamp",
       CAST(o_custkey % 181 - 90 AS DOUBLE) AS lat, CAST(o_custkey % 360 AS DOUBLE) AS lon
FROM orders""")
def lookup_file(spark, sf_dir):
    path = scratch_path(spark, "lookup")
    source = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("price_key"), (F.col("o_custkey") % 384).alias("site"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        (F.col("o_custkey") % 181 - 90).alias("lat"), (F.col("o_custkey") % 360).alias("lon"))
    write_csv(source, path, ["site", "lat", "lon", "timestamp", "price_key"])
    return load_lookup(spark, path, location_col="site", key="price_key")


@query("load_predictions", "WITH " + PAIRS + """
SELECT run, sample_id, "column", round(pred, 6) AS pred FROM pairs WHERE run IN ('m1', 'm5')""")
def run_predictions(spark, sf_dir):
    """Writes a submission CSV per run and loads them again in long form."""
    paths = {}
    for run in ("m1", "m5"):
        paths[run] = scratch_path(spark, f"run_{run}")
        write_csv(predictions(spark, sf_dir, run), f"{paths[run]}/submission_1", ["sample_id", *LABELS])
    schema = T.StructType([T.StructField("sample_id", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in LABELS]])
    return rounded(long_predictions(load_predictions(spark, paths, schema), "sample_id"))


@query("load_scores", "WITH " + PAIRS + """
SELECT run, CASE run WHEN 'm1' THEN 'exp001a' WHEN 'm2' THEN 'exp002a' WHEN 'm3' THEN 'exp002a'
                     WHEN 'm4' THEN 'exp003b' ELSE 'exp004c' END AS tag,
       "column", round(r2, 6) AS r2
FROM r2""")
def scores(spark, sf_dir):
    """Writes one sidecar per run below its tagged folder and loads them all again."""
    base = scratch_path(spark, "scores")
    tag = F.coalesce(*[F.when(F.col("run") == run, F.lit(tag)) for run, tag in RUN_TAGS.items()])
    r2 = r2_by_column(pairs(spark, sf_dir), by=("run", "column")).withColumn("tag", tag)
    write_parquet(r2, base, partition_by=["tag", "run"])
    paths = {run: f"{base}/tag={RUN_TAGS[run]}/run={run}" for run in RUNS}
    return rounded(load_scores(spark, paths))
