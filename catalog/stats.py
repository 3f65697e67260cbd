"""Statistics and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import SAMPLE_COLUMNS, SAMPLES, query, r6, rounded, samples, stats_sql, table
from strataframe.operators.frame import row_batches
from strataframe.operators.splits import batch_plan, holdout_split, split_counts
from strataframe.operators.states import add_states, merge_states, read_states
from strataframe.operators.stats import (
    MATRIX_ROWS, column_stats, describe, exp_rate, group_mean, level_stats, long_values,
    quality_report, stats_matrix)
from strataframe.functions.scaling import STAT_NAMES
from strataframe.session import scratch_path


def _long_sql(column: str) -> str:
    stats = ", ".join(f'round({column}__{s}, 6) AS "{s}"' for s in STAT_NAMES)
    return f"SELECT '{column}' AS \"column\", {stats} FROM st"


LINE_COLUMNS = ("quantity", "price", "discount", "tax")
LINES = """lines AS (SELECT l_quantity AS quantity, l_extendedprice / 100 AS price,
                            l_discount AS discount, l_tax AS tax FROM lineitem)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 100).alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


@query("column_stats", f"WITH {LINES}, {stats_sql('lines', LINE_COLUMNS)} "
       + " UNION ALL ".join(_long_sql(c) for c in LINE_COLUMNS))
def stats(spark, sf_dir):
    return rounded(column_stats(_lines(spark, sf_dir), LINE_COLUMNS, quantile="exact"))


@query("column_stats_default", f"WITH {LINES}, {stats_sql('lines', LINE_COLUMNS)} "
       + " UNION ALL ".join(_long_sql(c) for c in LINE_COLUMNS))
def stats_default(spark, sf_dir):
    """The statistics as shipped, compared in full."""
    return rounded(column_stats(_lines(spark, sf_dir), LINE_COLUMNS))


@query("column_stats_approx", f"""WITH {LINES}, {stats_sql('lines', LINE_COLUMNS)} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(f'round({c}__{s}, 6) AS "{s}"' for s in STAT_NAMES if s not in ("q1", "q2", "q3"))
    + ", TRUE AS q1_near, TRUE AS q2_near, TRUE AS q3_near FROM st" for c in LINE_COLUMNS))
def stats_approx(spark, sf_dir):
    """Quartiles of the sketch are approximate, so their ranks are counted over all rows and must be near."""
    lines = _lines(spark, sf_dir)
    found = column_stats(lines, LINE_COLUMNS, quantile="approx")
    ranks = long_values(lines, LINE_COLUMNS).join(F.broadcast(found.select("column", "q1", "q2", "q3")), "column").groupBy("column").agg(*[
        (F.avg((F.col("x") < F.col(f"q{i}")).cast("int")) <= i / 4 + 0.005).__and__(
            F.avg((F.col("x") <= F.col(f"q{i}")).cast("int")) >= i / 4 - 0.005).alias(f"q{i}_near") for i in (1, 2, 3)])
    return rounded(found.drop("q1", "q2", "q3").join(ranks, "column"))


@query("batch_states", f"""
WITH {SAMPLES}, b AS (SELECT *, o_orderkey // 250 AS batch_id FROM samples),
v AS (SELECT DISTINCT batch_id FROM b ORDER BY batch_id DESC LIMIT 3),
kept AS (SELECT * FROM b WHERE batch_id NOT IN (SELECT batch_id FROM v)), {stats_sql('kept', SAMPLE_COLUMNS)} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(f'round({c}__{s}, 6) AS "{s}"' for s in STAT_NAMES if s not in ("q1", "q2", "q3"))
    + ", TRUE AS q1_near, TRUE AS q2_near, TRUE AS q3_near FROM st" for c in SAMPLE_COLUMNS))
def kept_states(spark, sf_dir):
    """States of the even batches, then of the rest; all but the last three batches come from the states alone."""
    path = scratch_path(spark, "states")
    rows = row_batches(samples(spark, sf_dir), "o_orderkey", 250)
    add_states(rows.filter("batch_id % 2 = 0"), path, SAMPLE_COLUMNS)
    add_states(rows, path, SAMPLE_COLUMNS)
    last = rows.select("batch_id").distinct().orderBy(F.desc("batch_id")).limit(3)
    states = read_states(spark, path)
    found = merge_states(states.join(F.broadcast(last), "batch_id", "left_anti"))
    kept = rows.join(F.broadcast(last), "batch_id", "left_anti")
    ranks = long_values(kept, SAMPLE_COLUMNS).join(F.broadcast(found.select("column", "q1", "q2", "q3")), "column").groupBy("column").agg(*[
        (F.avg((F.col("x") < F.col(f"q{i}")).cast("int")) <= i / 4 + 0.02).__and__(
            F.avg((F.col("x") <= F.col(f"q{i}")).cast("int")) >= i / 4 - 0.02).alias(f"q{i}_near") for i in (1, 2, 3)])
    return rounded(found.drop("q1", "q2", "q3").join(ranks, "column"))


@query("column_stats_vec", f"""
WITH x AS (SELECT 'embedding_' || (generate_subscripts(embedding, 1) - 1) AS "column",
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT "column", round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
       round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2,
       round(quantile_cont(x, 0.75), 6) AS q3, round(min(x), 6) AS "min", round(max(x), 6) AS "max",
       round(1 / coalesce(avg(x) FILTER (WHERE x > 1e-7), 1e-50), 6) AS "lambda",
       round(sqrt(avg(x * x)), 6) AS std_y
FROM x GROUP BY "column" """)
def stats_vec(spark, sf_dir):
    return rounded(level_stats(table(spark, sf_dir, "embeddings"), ["embedding"], "exact"))


@query("exp_rate", """
SELECT l_returnflag, round(1 / coalesce(avg(l_discount) FILTER (WHERE l_discount > 1e-7), 1e-50), 6) AS rate,
       round(log10(1 / coalesce(avg(-l_tax) FILTER (WHERE -l_tax > 1e-7), 1e-50)), 6) AS log_rate_none
FROM lineitem GROUP BY l_returnflag""")
def rate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        r6(exp_rate(F.col("l_discount"))).alias("rate"),
        r6(F.log10(exp_rate(-F.col("l_tax")))).alias("log_rate_none"))


@query("stats_matrix", f"WITH {SAMPLES}, {stats_sql('samples', SAMPLE_COLUMNS)} " + " UNION ALL ".join(
    f"SELECT '{row}' AS stats, " + ", ".join(f"round({c}__{s}, 6) AS {c}" for c in SAMPLE_COLUMNS) + " FROM st"
    for row, s in zip(MATRIX_ROWS, STAT_NAMES)))
def matrix(spark, sf_dir):
    long = column_stats(samples(spark, sf_dir), SAMPLE_COLUMNS, quantile="exact")
    return rounded(stats_matrix(long, SAMPLE_COLUMNS))


@query("group_mean", """
SELECT l_orderkey, round(avg(CASE WHEN l_discount <> 0 THEN l_discount END), 6) AS discount
FROM lineitem GROUP BY l_orderkey""")
def means(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"))
    return rounded(group_mean(lines, "l_orderkey", "discount"))


@query("describe_column", """
WITH e AS (SELECT CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT 'v' AS "column", count(v) AS "count", count(*) - count(v) AS null_count, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS std, round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS p25,
       round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS "max"
FROM e""")
def described(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return rounded(describe(events, "v"))


@query("quality_report_profiles", """
WITH p AS (
  SELECT CASE WHEN vec_id % 9 = 4 THEN NULL ELSE list_transform(embedding, lambda x, i: CASE
           WHEN (vec_id + i) % 50 = 1 THEN NULL WHEN (vec_id + i) % 50 = 2 THEN CAST('nan' AS FLOAT)
           WHEN (vec_id + i) % 50 = 3 THEN CAST('-infinity' AS FLOAT) ELSE x END) END AS v, label FROM embeddings)
SELECT 'v' AS "column", count(*) AS rows,
       CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE len(list_filter(v, lambda x: x IS NULL)) END) AS BIGINT) AS null_count,
       CAST(sum(len(list_filter(v, lambda x: isnan(x)))) AS BIGINT) AS nan_count,
       CAST(sum(len(list_filter(v, lambda x: isinf(x)))) AS BIGINT) AS infinite_count FROM p
UNION ALL SELECT 'label', count(*), count(*) - count(label), 0, 0 FROM p""")
def quality_profiles(spark, sf_dir):
    at = (F.col("vec_id").cast("long"))
    holed = F.transform("embedding", lambda x, i: F.when((at + i + 1) % 50 == 1, None).when((at + i + 1) % 50 == 2, float("nan"))
                        .when((at + i + 1) % 50 == 3, float("-inf")).otherwise(x).cast("float"))
    rows = table(spark, sf_dir, "embeddings").select(F.when(at % 9 != 4, holed).alias("v"), "label")
    return quality_report(rows, ["v", "label"])


@query("quality_report", """
SELECT 'l_orderkey' AS "column", count(*) AS rows, 0 AS null_count, 0 AS nan_count, 0 AS infinite_count FROM lineitem
UNION ALL SELECT 'quantity', count(*), count(*) FILTER (WHERE l_quantity = 1), 0, 0 FROM lineitem
UNION ALL SELECT 'discount', count(*), 0, count(*) FILTER (WHERE l_discount = CAST(0.05 AS DOUBLE)), 0 FROM lineitem
UNION ALL SELECT 'tax', count(*), 0, 0, count(*) FILTER (WHERE l_tax = 0) FROM lineitem""")
def quality(spark, sf_dir):
    holed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_quantity") != 1, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_discount") == 0.05, float("nan")).otherwise(F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.col("l_tax")).alias("tax"))
    return quality_report(holed)


@query("batch_plan", """
WITH b AS (SELECT o_orderkey // 1000 AS batch_id FROM orders),
v AS (SELECT DISTINCT batch_id FROM b ORDER BY batch_id DESC LIMIT 5),
c AS (SELECT CASE WHEN batch_id IN (SELECT batch_id FROM v) THEN 'val' ELSE 'train' END AS split, count(*) AS n
      FROM b GROUP BY 1)
SELECT split, n, CASE WHEN split = 'train' THEN n // 512 ELSE (n + 511) // 512 END AS batches,
       n // 512 // 2 // 3 * 7 AS steps FROM c""")
def plan(spark, sf_dir):
    rows = row_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)
    return batch_plan(split_counts(holdout_split(rows, 5)), 512, devices=2, accumulate=3, epochs=7)
