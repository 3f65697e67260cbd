"""Lookup joins, feature tables and the flagship dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, r6, table
from strataframe.functions.profiles import unpack_families
from strataframe.operators.joins import (
    attach_by_key, lookup_join, prefiltered_build, tiered_lookup_join)
from strataframe.operators.stats import column_stats
from strataframe.plans.prepare import build_dataset, feature_table
from strataframe.schema import ProfileSchema


def _lookup(spark: SparkSession, sf_dir: str, key: str = "key") -> DataFrame:
    cust = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias(key), (cust % 384).alias("location"),
        F.col("o_orderdate").alias("timestamp"), (cust % 181 - 90).cast("double").alias("lat"),
        (cust % 360).cast("double").alias("lon"), F.col("o_orderkey").alias("entry"))


LOOKUP = """
lookup AS (
  SELECT o_totalprice AS key, o_custkey % 384 AS location, o_orderdate AS "timestamp",
         CAST(o_custkey % 181 - 90 AS DOUBLE) AS lat, CAST(o_custkey % 360 AS DOUBLE) AS lon,
         o_orderkey AS entry
  FROM orders)"""


def _first_sql(name: str, key: str, order: str = "entry") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT {key} AS k, location, "timestamp", lat, lon, entry,
                        row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM lookup)
  WHERE rn = 1)"""


@query("lookup_join", f"""
WITH {LOOKUP}, {_first_sql('one', 'key')}
SELECT 'train_' || o_orderkey AS sample_id, location, "timestamp", lat, lon
FROM orders JOIN one ON o_totalprice = k""")
def joined(spark, sf_dir):
    probe = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("train_"), "o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("key"))
    return lookup_join(probe, _lookup(spark, sf_dir), "key", on_duplicate="first", order=["entry"]).select(
        "sample_id", "location", "timestamp", "lat", "lon")


@query("tiered_lookup_join", f"""
WITH {LOOKUP}, {_first_sql('t1', 'key')}, {_first_sql('t2', 'round(key, 2)')}, {_first_sql('t3', 'round(key, 0)')},
probe AS (
  SELECT 'train_' || o_orderkey AS sample_id,
         o_totalprice + CASE o_orderkey % 3 WHEN 0 THEN CAST(0.0 AS DOUBLE) WHEN 1 THEN CAST(0.0001 AS DOUBLE)
                                            ELSE CAST(0.02 AS DOUBLE) END AS key FROM orders)
SELECT sample_id, round(key, 6) AS key,
       CASE WHEN t1.k IS NOT NULL THEN t1.location WHEN t2.k IS NOT NULL THEN t2.location ELSE t3.location END AS location,
       CASE WHEN t1.k IS NOT NULL THEN t1."timestamp" WHEN t2.k IS NOT NULL THEN t2."timestamp"
            ELSE t3."timestamp" END AS "timestamp",
       CASE WHEN t1.k IS NOT NULL THEN t1.entry WHEN t2.k IS NOT NULL THEN t2.entry ELSE t3.entry END AS entry,
       CASE WHEN t1.k IS NOT NULL THEN 1 WHEN t2.k IS NOT NULL THEN 2 WHEN t3.k IS NOT NULL THEN 3 END AS match_tier
FROM probe LEFT JOIN t1 ON key = t1.k LEFT JOIN t2 ON round(key, 2) = t2.k
           LEFT JOIN t3 ON round(key, 0) = t3.k""")
def tiered(spark, sf_dir):
    """A third of the keys match exactly, a third at two digits, a third only at none."""
    shift = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.0001, 0.02)]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    probe = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("train_"), "o_orderkey").alias("sample_id"), (F.col("o_totalprice") + shift).alias("key"))
    found = tiered_lookup_join(
        probe, _lookup(spark, sf_dir), "key", [(None, None), (2, None), (0, None)],
        on_miss="keep", on_duplicate="first", order=["entry"])
    return found.select("sample_id", r6("key").alias("key"), "location", "timestamp", "entry", "match_tier")


HOURLY = """
hourly AS (SELECT key, location, entry, "timestamp" + to_hours(entry % 24) AS "timestamp" FROM lookup),
slots AS (SELECT * FROM hourly WHERE hour("timestamp") IN (0, 8, 16) AND minute("timestamp") = 0)"""


@query("tiered_lookup_slots", f"""
WITH {LOOKUP}, {HOURLY},
t1 AS (SELECT key AS k, min(entry) AS entry FROM hourly GROUP BY key),
t2 AS (SELECT round(key, 2) AS k, min(entry) AS entry FROM slots GROUP BY round(key, 2)),
t3 AS (SELECT round(key, 0) AS k, min(entry) AS entry FROM slots GROUP BY round(key, 0)),
probe AS (
  SELECT 'train_' || o_orderkey AS sample_id,
         o_totalprice + CASE o_orderkey % 3 WHEN 0 THEN CAST(0.0 AS DOUBLE) WHEN 1 THEN CAST(0.0001 AS DOUBLE)
                                            ELSE CAST(0.02 AS DOUBLE) END AS key FROM orders),
found AS (
  SELECT sample_id, CASE WHEN t1.k IS NOT NULL THEN 1 WHEN t2.k IS NOT NULL THEN 2 WHEN t3.k IS NOT NULL THEN 3 END AS match_tier,
         coalesce(t1.entry, t2.entry, t3.entry) AS entry
  FROM probe LEFT JOIN t1 ON key = t1.k LEFT JOIN t2 ON round(key, 2) = t2.k LEFT JOIN t3 ON round(key, 0) = t3.k)
SELECT sample_id, match_tier, f.entry, h.location, h."timestamp" FROM found f LEFT JOIN hourly h ON f.entry = h.entry""")
def tiered_slots(spark, sf_dir):
    """Tiers beyond the first look among the rows of the time slots only, so many keys find nothing."""
    shift = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.0001, 0.02)]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    probe = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("train_"), "o_orderkey").alias("sample_id"), (F.col("o_totalprice") + shift).alias("key"))
    hourly = _lookup(spark, sf_dir).select("key", "location", "entry", (
        F.col("timestamp") + F.make_dt_interval(hours=(F.col("entry") % 24).cast("int"))).alias("timestamp"))

    def slots(lookup):
        return prefiltered_build(lookup, "timestamp", [0, 8, 16])

    found = tiered_lookup_join(probe, hourly, "key", [(None, None), (2, slots), (0, slots)],
                               on_miss="keep", on_duplicate="first", order=["entry"])
    return found.select("sample_id", "match_tier", "entry", "location", "timestamp")


@query("prefiltered_lookup", """
WITH hit AS (SELECT user_id, min(ts) AS ts FROM events
             WHERE hour(ts) IN (0, 8, 16) AND minute(ts) = 0 GROUP BY user_id)
SELECT e.event_id, hit.ts AS "timestamp" FROM events e LEFT JOIN hit ON e.user_id = hit.user_id""")
def prefiltered(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    build = prefiltered_build(events.select("user_id", F.col("ts").alias("timestamp")), "timestamp", [0, 8, 16])
    return lookup_join(events.select("event_id", "user_id"), build, "user_id", id_col="event_id",
                       on_miss="keep", on_duplicate="first").select("event_id", "timestamp")


@query("attach_by_key", """
SELECT o_orderkey, o_totalprice, q.quantity, q.lines
FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS lines
                  FROM lineitem GROUP BY l_orderkey) q ON o_orderkey = l_orderkey""")
def attached(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    return attach_by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), sums, "o_orderkey", on_miss="drop")


@query("attach_by_key_keep", """
SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber > 5) ON o_orderkey = l_orderkey""")
def attached_kept(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber > 5").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return attach_by_key(orders, lines, "o_orderkey", on_miss="keep", on_duplicate="keep")


@query("feature_table", f"""
WITH {LOOKUP}, {_first_sql('one', 'key', '"timestamp", location, lat, lon')}
SELECT 'train_' || o_orderkey AS sample_id, o_totalprice AS key, location, lat, lon,
       o_orderkey // 1000 AS year, CAST(month("timestamp") AS INTEGER) AS month,
       CAST(hour("timestamp") AS INTEGER) AS hour, CAST(dayofyear("timestamp") AS INTEGER) AS day
FROM orders JOIN one ON o_totalprice = k
UNION ALL
SELECT 'test_' || o_orderkey, o_totalprice, location, lat, lon, 7, month("timestamp"), hour("timestamp"),
       dayofyear("timestamp")
FROM orders JOIN one ON o_totalprice = k""")
def features(spark, sf_dir):
    lookup = _lookup(spark, sf_dir).drop("entry")
    orders = table(spark, sf_dir, "orders")
    parts = []
    for name in ("train", "test"):
        rows = orders.select(F.concat(F.lit(f"{name}_"), "o_orderkey").alias("sample_id"),
                             F.col("o_totalprice").alias("key"))
        parts.append(feature_table(rows, lookup, is_test=name == "test", key="key",
                                   samples_per_year=1000, on_duplicate="first"))
    return parts[0].unionByName(parts[1])


LEVELS = 64
DATASET = ProfileSchema(in_scalars=("s_id",), in_families=("emb",), out_scalars=(), out_families=(), levels=LEVELS)


def _raw_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("train_"), F.col("vec_id")).alias("sample_id"), (F.col("vec_id") / 100).alias("s_id"),
        F.col("embedding").cast("array<double>").alias("emb"))
    return unpack_families(packed, ["emb"], LEVELS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup join, calendar columns, statistics, scaling, cast, packing: the processed table.

    The lookup is by `s_id`, which belongs to one sample; single components of the vectors meet by chance
    among ten thousand. A sample without a vector has no lookup row.
    """
    raw = _raw_profiles(spark, sf_dir)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "ts")
    known = table(spark, sf_dir, "embeddings").filter(F.col("embedding")[2].isNotNull())
    lookup = known.join(events, "vec_id").select(
        (F.col("vec_id") / 100).alias("s_id"), F.col("label").cast("long").alias("location"),
        F.col("ts").alias("timestamp"), (F.col("vec_id") % 181 - 90).cast("double").alias("lat"),
        (F.col("vec_id") % 360).cast("double").alias("lon"))
    stats = column_stats(raw, DATASET.input_columns)
    return build_dataset(raw, lookup, stats, DATASET, key="s_id", samples_per_year=100)


@query("build_dataset", """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS level,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
st AS (SELECT level, avg(x) AS mean, stddev_samp(x) AS std FROM x GROUP BY level),
s AS (SELECT avg(vec_id / 100) AS mean, stddev_samp(vec_id / 100) AS std FROM embeddings)
SELECT 'train_' || e.vec_id AS sample_id,
       round(CAST(CAST((e.vec_id / 100 - s.mean) / s.std AS REAL) AS DOUBLE), 5) AS s_id,
       CAST(e.label AS BIGINT) AS location, CAST(e.vec_id % 181 - 90 AS REAL) AS lat, CAST(e.vec_id % 360 AS REAL) AS lon,
       e.vec_id // 100 AS year, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(dayofyear(ts) AS INTEGER) AS day, CAST(x.level AS INTEGER) AS level,
       round(CAST(CAST((x.x - st.mean) / st.std AS REAL) AS DOUBLE), 5) AS x
FROM embeddings e JOIN events ON event_id = e.vec_id JOIN x ON x.vec_id = e.vec_id JOIN st ON st.level = x.level, s""")
def dataset(spark, sf_dir):
    packed = flagship(spark, sf_dir)
    return packed.select(
        "sample_id", r6(F.col("s_id").cast("double"), 5).alias("s_id"), "location", "lat", "lon", "year", "month",
        "hour", "day", F.posexplode(F.col("emb").cast("array<double>")).alias("level", "x")).withColumn(
        "x", r6("x", 5))
