"""Post-processing, evaluation tables and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    LABEL_TABLE, LABELS, PAIRS, RUNS, WEIGHTS, label_table, pairs, predictions, predictions_sql,
    query, rounded, stats_sql, table, weight_table)
from strataframe.functions.scaling import collect_stats
from strataframe.operators.ensemble import ensemble_top_k
from strataframe.operators.metrics import r2_by_column
from strataframe.operators.post import (
    apply_weights, clip_columns, collect_constants, evaluation_table, fill_broken, override_closed_form,
    post_process)
from strataframe.operators.stats import column_stats

M1 = LABEL_TABLE + "," + predictions_sql("m1")
INPUTS = """
inputs AS (SELECT 'train_' || o_orderkey AS sample_id, CAST(o_custkey AS DOUBLE) AS x_4 FROM orders)"""


def _inputs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("train_"), "o_orderkey").alias("sample_id"), F.col("o_custkey").cast("double").alias("x_4"))


def _label_stats(spark, sf_dir):
    return collect_stats(column_stats(label_table(spark, sf_dir), LABELS))


def _means(stats):
    return {c: s["mean"] for c, s in stats.items()}


@query("fill_broken", f"""WITH {M1}
SELECT sample_id, round(y_1, 6) AS y_1, round((SELECT avg(y_2) FROM labels_t), 6) AS y_2,
       round(y_3, 6) AS y_3, round((SELECT avg(y_4) FROM labels_t), 6) AS y_4 FROM m1""")
def fill(spark, sf_dir):
    means = _means(_label_stats(spark, sf_dir))
    return rounded(fill_broken(predictions(spark, sf_dir, "m1"), ["y_2", "y_4"], means))


@query("clip_columns", f"""WITH {M1}
SELECT sample_id, round(y_1, 6) AS y_1, round(greatest(y_2, 0.0), 6) AS y_2, round(y_3, 6) AS y_3,
       round(greatest(y_4, 0.0), 6) AS y_4 FROM m1""")
def clip(spark, sf_dir):
    return rounded(clip_columns(predictions(spark, sf_dir, "m1"), ["y_2", "y_4"]))


@query("override_closed_form", f"""WITH {M1}, {INPUTS}
SELECT sample_id, round(y_1, 6) AS y_1, round(y_2, 6) AS y_2,
       round(CASE WHEN x_4 < 500 THEN -x_4 / 1200 ELSE y_3 END, 6) AS y_3, round(-x_4 / 1200, 6) AS y_4
FROM m1 JOIN inputs USING (sample_id)""")
def override(spark, sf_dir):
    inputs = _inputs(spark, sf_dir)
    always = override_closed_form(predictions(spark, sf_dir, "m1"), inputs, {"y_4": "x_4"})
    return rounded(override_closed_form(always, inputs, {"y_3": "x_4"}, below=500))


@query("apply_weights", f"""WITH {M1}, {WEIGHTS}, w AS (SELECT "column" AS c, weight AS w FROM weights)
SELECT sample_id, round(y_1 * (SELECT w FROM w WHERE c = 'y_1'), 6) AS y_1,
       round(abs(y_2 * (SELECT w FROM w WHERE c = 'y_2')), 6) AS y_2,
       round(y_3 * (SELECT w FROM w WHERE c = 'y_3'), 6) AS y_3,
       round(y_4 * (SELECT w FROM w WHERE c = 'y_4'), 6) AS y_4 FROM m1""")
def weigh(spark, sf_dir):
    weights = collect_constants(weight_table(spark, sf_dir))
    weighed = apply_weights(predictions(spark, sf_dir, "m1"), weights)
    # A weight of zero leaves zeros of either sign.
    return rounded(weighed.withColumn("y_2", F.abs("y_2")))


@query("post_process", f"""WITH {M1}, {INPUTS}, {WEIGHTS}, {stats_sql('labels_t', LABELS)},
w AS (SELECT max(weight) FILTER (WHERE "column" = 'y_1') AS y_1, max(weight) FILTER (WHERE "column" = 'y_3') AS y_3,
             max(weight) FILTER (WHERE "column" = 'y_4') AS y_4 FROM weights)
SELECT sample_id, round(-x_4 / 1200 * w.y_4, 6) AS y_4,
       round(greatest(m1.y_1 * y_1__std + y_1__mean, 0.0) * w.y_1, 6) AS y_1,
       round(y_3__mean * w.y_3, 6) AS y_3
FROM m1 JOIN inputs USING (sample_id), st, w""")
def final(spark, sf_dir):
    stats = _label_stats(spark, sf_dir)
    weights = collect_constants(weight_table(spark, sf_dir))
    return rounded(post_process(
        predictions(spark, sf_dir, "m1"), {"standard": ["y"], "robust": []}, stats, broken=["y_3"],
        means=_means(stats), weights={c: weights[c] for c in ("y_4", "y_1", "y_3")},
        inputs=_inputs(spark, sf_dir), clipped=["y_1"], mapping={"y_4": "x_4"}))


@query("evaluation_table", f"""WITH {M1}
SELECT sample_id AS sample_id_label, """ + ", ".join(
    f"round(l.{c}, 6) AS {c}_label, round(m1.{c}, 6) AS {c}" for c in LABELS)
    + " FROM labels_t l JOIN m1 USING (sample_id)")
def evaluation(spark, sf_dir):
    labels = label_table(spark, sf_dir).drop("k")
    return rounded(evaluation_table(labels, predictions(spark, sf_dir, "m1"), LABELS))


@query("ensemble_top_k", f"""WITH {PAIRS},
ranked AS (SELECT "column", run, row_number() OVER (PARTITION BY "column" ORDER BY r2 DESC, run) AS rank
           FROM r2 WHERE r2 > 0),
chosen AS (SELECT "column", run FROM ranked WHERE rank <= 3
           UNION ALL SELECT c, 'm5' FROM (SELECT unnest(['y_1', 'y_2', 'y_3', 'y_4']) AS c)
           WHERE c NOT IN (SELECT "column" FROM ranked)),
means AS (SELECT sample_id, p."column", avg(pred) AS v
          FROM pairs p JOIN chosen USING ("column", run) GROUP BY sample_id, p."column")
SELECT sample_id, """ + ", ".join(
    f"round(max(v) FILTER (WHERE \"column\" = '{c}'), 6) AS {c}" for c in LABELS)
    + " FROM means GROUP BY sample_id")
def ensemble(spark, sf_dir):
    scores = r2_by_column(pairs(spark, sf_dir), by=("run", "column"))
    preds = {run: predictions(spark, sf_dir, run) for run in RUNS}
    return rounded(ensemble_top_k(scores, preds, LABELS, k=3))
