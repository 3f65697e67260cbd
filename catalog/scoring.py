"""Batch scoring and the linear baseline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from strataframe.operators.scoring import (
    LinearModel, RidgeChoice, fit_linear, fit_linear_cv, score, score_many)

LEVELS = 64


def _model(shift: float) -> LinearModel:
    level = np.arange(LEVELS)
    weights = np.stack([(level - 31.5) / 64 + shift, (level % 5) / 5 - shift], axis=1)
    return LinearModel(weights, np.array([0.25, -0.5]))


def _score_sql(name: str, shift: float) -> str:
    s = f"CAST({shift} AS DOUBLE)"
    return f"""SELECT '{name}' AS model, vec_id,
       round(0.25 + list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * ((i - 31.5) / 64 + {s}))), 6) AS y_0,
       round(-0.5 + list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * ((i % 5) / 5 - {s}))), 6) AS y_1
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def _inputs():
    return [f"embedding[{i}]" for i in range(LEVELS)]


@query("score_linear", f"SELECT vec_id, y_0, y_1 FROM ({_score_sql('a', 0.0)})")
def linear(spark, sf_dir):
    return rounded(score(table(spark, sf_dir, "embeddings"), _model(0.0).predictor(), _inputs(),
                         ["y_0", "y_1"], "vec_id"))


@query("score_many", _score_sql("a", 0.0) + " UNION ALL " + _score_sql("b", 0.1))
def many(spark, sf_dir):
    models = {"a": _model(0.0).predictor(), "b": _model(0.1).predictor()}
    return rounded(score_many(table(spark, sf_dir, "embeddings"), models, _inputs(), ["y_0", "y_1"], "vec_id"))


@query("fit_linear_multi", """
WITH c AS (SELECT l_quantity - avg(l_quantity) OVER () AS a, l_discount * 100 - avg(l_discount * 100) OVER () AS b,
                  l_extendedprice / 10000 AS y, l_tax * 100 AS z FROM lineitem),
s AS (SELECT sum(a * a) + 5 AS aa, sum(b * b) + 5 AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_,
             sum(a * z) AS az, sum(b * z) AS bz, avg(y) AS my, avg(z) AS mz FROM c),
m AS (SELECT avg(l_quantity) AS ma, avg(l_discount * 100) AS mb FROM lineitem),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ya, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS yb,
             (az * bb - bz * ab) / (aa * bb - ab * ab) AS za, (bz * aa - az * ab) / (aa * bb - ab * ab) AS zb, my, mz, ma, mb FROM s, m)
SELECT l_orderkey, l_linenumber, l_partkey,
       round(my + ya * (l_quantity - ma) + yb * (l_discount * 100 - mb), 6) AS y,
       round(mz + za * (l_quantity - ma) + zb * (l_discount * 100 - mb), 6) AS z FROM lineitem, w""")
def fitted_many(spark, sf_dir):
    """Two inputs, two labels, ridge with a free intercept."""
    lines = table(spark, sf_dir, "lineitem")
    inputs = ["l_quantity", "l_discount * 100"]
    model = fit_linear(lines, inputs, ["l_extendedprice / 10000", "l_tax * 100"], ridge=5.0)
    found = [F.lit(float(model.bias[k])) + F.lit(float(model.weights[0, k])) * F.col("l_quantity")
             + F.lit(float(model.weights[1, k])) * F.col("l_discount") * 100 for k in range(2)]
    return rounded(lines.select("l_orderkey", "l_linenumber", "l_partkey", found[0].alias("y"), found[1].alias("z")))


@query("fit_linear_1d", """
WITH f AS (SELECT regr_slope(l_extendedprice / 10000, l_quantity) AS slope,
                  regr_intercept(l_extendedprice / 10000, l_quantity) AS intercept FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(slope * l_quantity + intercept, 6) AS fitted FROM lineitem, f""")
def fitted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    model = fit_linear(lines, ["l_quantity"], ["l_extendedprice / 10000"])
    slope, intercept = float(model.weights[0, 0]), float(model.bias[0])
    return rounded(lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"),
        (F.lit(slope) * F.col("l_quantity") + intercept).alias("fitted")))


RIDGES = (0.0, 50.0, 2_000_000.0)


@query("fit_linear_cv", f"""
WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS a, l_discount * 100 AS b, l_extendedprice / 10000 AS y, l_tax * 100 AS z,
                  CAST('0x' || substr(md5('42:' || CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 3 AS fold FROM lineitem),
t AS (SELECT g.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, avg(z) AS mz, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb,
             covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_,
             covar_pop(a, z) * count(*) AS az, covar_pop(b, z) * count(*) AS bz
      FROM (SELECT unnest([0, 1, 2]) AS fold) g JOIN r ON r.fold <> g.fold GROUP BY g.fold),
p AS (SELECT *, (aa + ridge) * (bb + ridge) - ab * ab AS d FROM t, (SELECT unnest({list(RIDGES)}::DOUBLE[]) AS ridge)),
w AS (SELECT *, (ay * (bb + ridge) - by_ * ab) / d AS ya, (by_ * (aa + ridge) - ay * ab) / d AS yb,
             (az * (bb + ridge) - bz * ab) / d AS za, (bz * (aa + ridge) - az * ab) / d AS zb FROM p),
e AS (SELECT ridge, y, z, y - my - ya * (a - ma) - yb * (b - mb) AS ey, z - mz - za * (a - ma) - zb * (b - mb) AS ez
      FROM r JOIN w USING (fold)),
s AS (SELECT ridge, avg(ey * ey) AS ye, 1 - avg(ey * ey) / var_pop(y) AS yr, avg(ez * ez) AS ze, 1 - avg(ez * ez) / var_pop(z) AS zr
      FROM e GROUP BY ridge),
c AS (SELECT ridge, (yr + zr) = max(yr + zr) OVER () AS chosen, ye, yr, ze, zr FROM s)
SELECT ridge, 'y' AS "column", round(ye, 6) AS mse, round(yr, 6) AS r2, chosen FROM c
UNION ALL SELECT ridge, 'z', round(ze, 6), round(zr, 6), chosen FROM c""")
def chosen(spark, sf_dir):
    """Three penalties, three folds by order key, errors from the sums of one pass."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_quantity AS a", "l_discount * 100 AS b", "l_extendedprice / 10000 AS y", "l_tax * 100 AS z")
    found = fit_linear_cv(lines, ["a", "b"], ["y", "z"], RIDGES, "l_orderkey", folds=3)
    scores = spark.createDataFrame(found.scores, RidgeChoice.SCHEMA)
    return rounded(scores.withColumn("chosen", F.col("ridge") == found.ridge))
