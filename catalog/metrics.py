"""Scores of runs, masks, losses and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    LABEL_TABLE, LABELS, PAIRS, WEIGHTS, label_table, pairs, predictions, predictions_sql, query,
    rounded, weight_table)
from strataframe.operators.metrics import (
    best_epoch, broken_columns, column_mask, compare_runs, error_share, huber_loss, incomplete_pairs, r2_by_column, r2_summary,
    series_head, top_k, worst_samples)
from strataframe.operators.post import evaluation_table

MASK = WEIGHTS + """,
mask AS (SELECT "column", weight <> 0 AND "column" NOT IN ('y_3') AS keep FROM weights)"""
SCORED = """,
scored AS (SELECT run, r2."column", CASE WHEN keep THEN r2 ELSE 1.0 END AS masked
           FROM r2 JOIN mask ON r2."column" = mask."column")"""


def _r2(spark, sf_dir):
    return r2_by_column(pairs(spark, sf_dir), by=("run", "column"))


def _mask(spark, sf_dir):
    return column_mask(weight_table(spark, sf_dir), unused=["y_3"])


@query("column_mask", f"WITH {LABEL_TABLE}, {MASK} SELECT \"column\", keep FROM mask")
def mask(spark, sf_dir):
    return _mask(spark, sf_dir)


@query("r2_by_column", f"WITH {PAIRS} SELECT run, \"column\", round(r2, 6) AS r2 FROM r2")
def r2(spark, sf_dir):
    return rounded(_r2(spark, sf_dir))


@query("r2_incomplete", f"""WITH {PAIRS},
holes AS (SELECT run, "column", y, CASE WHEN CAST(substr(sample_id, 7) AS BIGINT) % 7 = 3 THEN NULL ELSE pred END AS pred FROM pairs)
SELECT h.run, h."column", round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2, any_value(i.n) AS incomplete
FROM holes h JOIN (SELECT run, "column", count(*) AS n FROM holes WHERE pred IS NULL GROUP BY ALL) i
  ON h.run = i.run AND h."column" = i."column" WHERE pred IS NOT NULL GROUP BY h.run, h."column\"""")
def incomplete(spark, sf_dir):
    hole = F.substring("sample_id", 7, 20).cast("long") % 7 == 3
    holed = pairs(spark, sf_dir).withColumn("pred", F.when(~hole, F.col("pred")))
    by = ["run", "column"]
    return rounded(r2_by_column(holed, by=by)).join(incomplete_pairs(holed, by=by), by)


@query("r2_summary", f"""WITH {PAIRS}, {MASK} {SCORED}
SELECT run, round(avg(CASE WHEN masked < 1e-6 THEN 0.0 ELSE masked END), 6) AS val_r2,
       count(*) FILTER (WHERE masked < 1e-6) AS r2_broken FROM scored GROUP BY run""")
def summary(spark, sf_dir):
    return rounded(r2_summary(_r2(spark, sf_dir), _mask(spark, sf_dir), by=("run",)))


@query("broken_columns", f"""WITH {PAIRS}, {MASK} {SCORED} SELECT run, "column" FROM scored WHERE masked < 1e-6""")
def broken(spark, sf_dir):
    return broken_columns(_r2(spark, sf_dir), _mask(spark, sf_dir))


@query("best_epoch", f"""WITH {PAIRS}, {MASK} {SCORED},
best AS (SELECT run FROM scored GROUP BY run
         ORDER BY avg(CASE WHEN masked < 1e-6 THEN 0.0 ELSE masked END) DESC, run DESC LIMIT 1)
SELECT run, "column", round(r2, 6) AS r2 FROM r2 WHERE run IN (SELECT run FROM best)""")
def best(spark, sf_dir):
    return rounded(best_epoch(_r2(spark, sf_dir), "run", _mask(spark, sf_dir)))


@query("best_epoch_broken", f"""WITH {PAIRS}, {MASK} {SCORED},
best AS (SELECT run FROM scored GROUP BY run ORDER BY count(*) FILTER (WHERE masked < 1e-6), run DESC LIMIT 1)
SELECT run, "column", round(r2, 6) AS r2 FROM r2 WHERE run IN (SELECT run FROM best)""")
def fewest_broken(spark, sf_dir):
    return rounded(best_epoch(_r2(spark, sf_dir), "run", _mask(spark, sf_dir), mode="min", monitor="r2_broken"))


@query("huber_loss",f"""WITH {PAIRS}, {MASK},
e AS (SELECT abs(pred - y) AS e FROM pairs JOIN mask ON pairs."column" = mask."column" WHERE keep)
SELECT round(avg(CASE WHEN e <= 0.5 THEN 0.5 * e * e ELSE 0.5 * (e - 0.5 * 0.5) END), 6) AS loss FROM e""")
def huber(spark, sf_dir):
    return rounded(huber_loss(pairs(spark, sf_dir), delta=0.5, mask=_mask(spark, sf_dir)))


ERRORS = LABEL_TABLE + "," + predictions_sql("m1") + """,
e AS (SELECT l.sample_id, m.y_1 AS pred, l.y_1 AS label, (m.y_1 - l.y_1) * (m.y_1 - l.y_1) AS diff
      FROM labels_t l JOIN m1 m ON l.sample_id = m.sample_id)"""


def _shares(spark, sf_dir):
    labels = label_table(spark, sf_dir).drop("k")
    wide = evaluation_table(labels, predictions(spark, sf_dir, "m1"), LABELS)
    shares = error_share(wide.select("sample_id_label", "y_1", "y_1_label"), "y_1", "y_1_label")
    return shares.withColumnRenamed("sample_id_label", "sample_id")


def _ppm(df):
    return rounded(df.select("sample_id", "diff", (F.col("diff_ratio") * 1e4).alias("share_1e4")))


@query("error_share", f"""WITH {ERRORS}
SELECT sample_id, round(diff, 6) AS diff, round(diff / (SELECT sum(diff) FROM e) * 1e4, 6) AS share_1e4 FROM e""")
def share(spark, sf_dir):
    return _ppm(_shares(spark, sf_dir))


@query("worst_samples", f"""WITH {ERRORS}
SELECT sample_id, round(diff, 6) AS diff, round(diff / (SELECT sum(diff) FROM e) * 1e4, 6) AS share_1e4 FROM e
ORDER BY e.diff DESC, sample_id LIMIT 100""")
def worst(spark, sf_dir):
    return _ppm(worst_samples(_shares(spark, sf_dir), 100, "sample_id"))


@query("series_head", f"""WITH {LABEL_TABLE}
SELECT k, round(y_1, 6) AS y_1, round(y_2, 6) AS y_2 FROM labels_t ORDER BY k LIMIT 1000""")
def series(spark, sf_dir):
    return rounded(series_head(label_table(spark, sf_dir), ["y_1", "y_2"], "k", 1000))


@query("compare_runs", f"""WITH {PAIRS}
SELECT a."column", round(greatest(a.r2, -1.0), 6) AS r2_first, round(greatest(b.r2, -1.0), 6) AS r2_second
FROM r2 a JOIN r2 b ON a."column" = b."column" WHERE a.run = 'm1' AND b.run = 'm5'""")
def compare(spark, sf_dir):
    scores = _r2(spark, sf_dir)
    return rounded(compare_runs(scores.filter("run = 'm1'"), scores.filter("run = 'm5'")))


@query("top_k_models", f"""WITH {PAIRS}
SELECT "column", run, round(r2, 6) AS r2, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY r2 DESC, run) AS rank FROM r2 WHERE r2 > 0)
WHERE rank <= 3""")
def top_models(spark, sf_dir):
    return rounded(top_k(_r2(spark, sf_dir), 3).select("column", "run", "r2", "rank"))
