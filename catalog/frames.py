"""Projections, filters, scalar functions, orderings and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import TWO_PI, query, r6, samples, table
from strataframe.functions.profiles import unpack_families
from strataframe.functions.scalar import (
    calendar, clip_lower, cyclic_features, decode_id, override_when, run_tag, sample_number, year_index)
from strataframe.operators.frame import (
    cast_floats, exclude, filter_time_slots, natural_order, select_ordered, sort_by_id, suffix_all,
    union_all, with_literal)
from strataframe.operators.stats import long_values
from strataframe.schema import ProfileSchema


@query("select_ordered", "SELECT s_acctbal, s_name, s_suppkey FROM supplier")
def ordered(spark, sf_dir):
    return select_ordered(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_name", "s_suppkey"])


@query("exclude_columns", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
                                    l_linestatus, l_shipdate FROM lineitem""")
def excluded(spark, sf_dir):
    return exclude(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("suffix_all", """SELECT p_partkey AS p_partkey_label, p_name AS p_name_label,
  p_brand AS p_brand_label, p_type AS p_type_label, p_size AS p_size_label,
  p_retailprice AS p_retailprice_label FROM part""")
def suffixed(spark, sf_dir):
    return suffix_all(table(spark, sf_dir, "part"), "_label")


@query("cast_floats", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS REAL) AS l_quantity,
  CAST(l_extendedprice AS REAL) AS l_extendedprice, CAST(l_discount AS REAL) AS l_discount FROM lineitem""")
def floats(spark, sf_dir):
    return cast_floats(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"))


@query("filter_time_slots", """SELECT event_id, ts, user_id, value FROM events
  WHERE hour(ts) IN (0, 8, 16) AND minute(ts) = 0""")
def slots(spark, sf_dir):
    return filter_time_slots(table(spark, sf_dir, "events"), "ts", [0, 8, 16]).select(
        "event_id", "ts", "user_id", "value")


@query("calendar_features", """SELECT event_id, CAST(7 AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofyear(ts) AS INTEGER) AS day FROM events""")
def calendar_columns(spark, sf_dir):
    events = with_literal(table(spark, sf_dir, "events"), "year", 7)
    return events.select("event_id", "year", *[c.alias(n) for n, c in calendar(F.col("ts")).items()])


@query("cyclic_features", f"""
WITH e AS (SELECT event_id, CAST(user_id % 181 - 90 AS DOUBLE) AS lat,
                  CAST(user_id % 360 AS DOUBLE) AS lon, hour(ts) AS h, dayofyear(ts) AS d FROM events)
SELECT event_id, round(lat / 90, 6) AS lat_unit,
       round(cos({TWO_PI} * lon / 360), 6) AS lon_cos, round(sin({TWO_PI} * lon / 360), 6) AS lon_sin,
       round(cos({TWO_PI} * h / 24), 6) AS hour_cos, round(sin({TWO_PI} * h / 24), 6) AS hour_sin,
       round(cos({TWO_PI} * d / 366), 6) AS day_cos, round(sin({TWO_PI} * d / 366), 6) AS day_sin
FROM e""")
def cyclic(spark, sf_dir):
    lat, lon = (F.col("user_id") % 181 - 90).cast("double"), (F.col("user_id") % 360).cast("double")
    features = cyclic_features(lat, lon, F.hour("ts"), F.dayofyear("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id", *[r6(c).alias(n) for n, c in features.items()])


@query("sample_number", """SELECT 'train_' || o_orderkey || '_v2' AS sample_id, o_orderkey AS number FROM orders
UNION ALL SELECT o_orderstatus, NULL FROM orders""")
def number(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ids = union_all([
        orders.select(F.concat(F.lit("train_"), "o_orderkey", F.lit("_v2")).alias("sample_id")),
        orders.select(F.col("o_orderstatus").alias("sample_id"))])
    return ids.select("sample_id", sample_number(F.col("sample_id")).alias("number"))


@query("year_index", "SELECT 'train_' || o_orderkey AS sample_id, o_orderkey // 1234 AS year FROM orders")
def year(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", year_index(F.col("sample_id"), 1234).alias("year"))


@query("round_keys", """
SELECT o_orderkey, CAST(round(round(o_totalprice * 1.2345678e-13, 15) * 1e15) AS BIGINT) AS digits_15,
       CAST(round(round(o_totalprice * 1.2345678e-13, 18) * 1e18) AS BIGINT) AS digits_18,
       round(o_totalprice / 7, 3) AS digits_3
FROM orders""")
def round_keys(spark, sf_dir):
    tiny = F.col("o_totalprice") * 1.2345678e-13
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(F.round(tiny, 15) * 1e15).cast("bigint").alias("digits_15"),
        F.round(F.round(tiny, 18) * 1e18).cast("bigint").alias("digits_18"),
        F.round(F.col("o_totalprice") / 7, 3).alias("digits_3"))


@query("clip_lower", """
SELECT c_custkey, greatest(c_acctbal, 0.0) AS clipped,
       CASE WHEN c_nationkey = 3 THEN NULL ELSE greatest(c_acctbal, 100.0) END AS clipped_or_null
FROM customer""")
def clipped(spark, sf_dir):
    holed = F.when(F.col("c_nationkey") != 3, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", clip_lower(F.col("c_acctbal"), 0).alias("clipped"),
        clip_lower(holed, 100).alias("clipped_or_null"))


@query("override_when", """
SELECT o_orderkey, round(CASE WHEN o_totalprice < 100000 THEN -o_totalprice / 1200
                              ELSE o_custkey END, 6) AS value FROM orders""")
def override(spark, sf_dir):
    price = F.col("o_totalprice")
    value = override_when(price < 100000, -price / 1200, F.col("o_custkey").cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(value).alias("value"))


@query("run_tag", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL
  ELSE 'exp' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || substr('abcd', 1 + o_orderkey % 4, 1) END AS tag
FROM orders""")
def tag(spark, sf_dir):
    path = F.concat(F.lit("../output/exp"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"),
                    F.substring(F.lit("abcd"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1)), F.lit("/run0/"))
    return table(spark, sf_dir, "orders").select("o_orderkey", run_tag(path).alias("tag"))


@query("decode_id", "SELECT doc_id, source || ':' || lang AS name FROM documents")
def decoded(spark, sf_dir):
    raw = F.encode(F.concat_ws(":", "source", "lang"), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", decode_id(raw).alias("name"))


@query("sort_by_id", "SELECT 'train_' || o_orderkey AS sample_id, o_totalprice FROM orders")
def by_id(spark, sf_dir):
    return sort_by_id(table(spark, sf_dir, "orders").select(
        F.concat(F.lit("train_"), "o_orderkey").alias("sample_id"), "o_totalprice"))


@query("natural_order", """
WITH x AS (SELECT 'emb_' || (generate_subscripts(embedding, 1) - 1) AS name,
                  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT name, round(avg(v), 6) AS mean FROM x GROUP BY name""")
def natural(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    means = emb.groupBy(F.concat(F.lit("emb_"), F.col("i").cast("string")).alias("name")).agg(
        r6(F.avg(F.col("v").cast("double"))).alias("mean"))
    return natural_order(means, "name")


@query("union_all", """
SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier
UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer""")
def unioned(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return union_all([c, s, c])


@query("label_list", """
WITH x AS (SELECT 'emb_' || (generate_subscripts(embedding, 1) - 1) AS label,
                  generate_subscripts(embedding, 1) AS position, CAST(unnest(embedding) AS DOUBLE) AS v
           FROM embeddings)
SELECT 'grade' AS label, 0 AS position, count(*) AS n, round(avg(label), 6) AS mean FROM embeddings
UNION ALL SELECT label, position, count(*), round(avg(v), 6) FROM x GROUP BY label, position""")
def label_list(spark, sf_dir):
    """The flat label list as a table, joined to the values of each label."""
    schema = ProfileSchema((), (), ("grade",), ("emb",), levels=64)
    wide = unpack_families(table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("double").alias("grade"), F.col("embedding").alias("emb")), ["emb"], 64)
    labels = spark.createDataFrame(list(enumerate(schema.label_columns)), "position long, label string")
    values = long_values(wide, schema.label_columns).groupBy(F.col("column").alias("label")).agg(
        F.count("*").alias("n"), r6(F.avg("x")).alias("mean"))
    return labels.join(values, "label").select("label", "position", "n", "mean")
