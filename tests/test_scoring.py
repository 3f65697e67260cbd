import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strataframe.operators.scoring import fit_linear, fit_linear_cv, score, score_many


@pytest.fixture(scope="module")
def rows(spark):
    x, z = F.col("id") % 17 / 17.0, F.col("id") % 5 / 5.0
    return spark.range(500).repartition(7).select(
        F.concat(F.lit("s"), "id").alias("sample_id"), x.alias("x"), z.alias("z"),
        (2 * x - 3 * z + 1).alias("y1"), (z * 0.5).alias("y2"))


def test_fit_recovers_weights(rows):
    model = fit_linear(rows, ["x", "z"], ["y1", "y2"])
    assert model.weights == pytest.approx(np.array([[2, 0], [-3, 0.5]]), abs=1e-8)
    assert model.bias == pytest.approx(np.array([1, 0]), abs=1e-8)


def test_ridge_matches_closed_form(rows):
    model = fit_linear(rows, ["x", "z"], ["y1"], ridge=10.0)
    data = rows.toPandas()
    x = np.column_stack([np.ones(len(data)), data["x"], data["z"]])
    want = np.linalg.solve(x.T @ x + np.diag([0, 10.0, 10.0]), x.T @ data["y1"])
    assert np.r_[model.bias, model.weights[:, 0]] == pytest.approx(want)


def test_score(rows):
    model = fit_linear(rows, ["x", "z"], ["y1", "y2"])
    out = score(rows, model.predictor(), ["x", "z"], ["p1", "p2"]).join(rows, "sample_id")
    assert out.count() == 500
    assert out.filter((F.abs(F.col("p1") - F.col("y1")) > 1e-8) | (F.abs(F.col("p2") - F.col("y2")) > 1e-8)).count() == 0


def test_score_many(rows):
    out = score_many(rows, {"a": lambda x: x[:, :1], "b": lambda x: -x[:, :1]}, ["x", "z"], ["p"])
    sums = {r["model"]: r["s"] for r in out.groupBy("model").agg(F.sum("p").alias("s")).collect()}
    assert sums["a"] == pytest.approx(-sums["b"])


def test_wrong_width(rows):
    with pytest.raises(PySparkException, match="gave"):
        score(rows, lambda x: x, ["x", "z"], ["p"]).collect()


def test_no_rows(rows):
    assert score(rows.limit(0), lambda x: x, ["x"], ["p"]).count() == 0
    with pytest.raises(ValueError):
        fit_linear(rows.limit(0), ["x"], ["y1"])


def test_cross_validation_equals_refitting(spark):
    x, z, noise = F.sin("id"), F.cos(F.col("id") * 3.7), F.sin(F.col("id") * 91.3)
    rows = spark.range(300).select("id", x.alias("x"), z.alias("z"), (x + z).alias("both"), (2 * x - z + noise).alias("y"),
                                   F.lit(4.0).alias("flat")).repartition(7)
    ridges = [0.0, 1.0, 40.0, 5000.0]
    found = fit_linear_cv(rows, ["x", "z", "both"], ["y", "flat"], ridges, "id", folds=4)
    key = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % 4
    data = rows.withColumn("fold", key).toPandas()
    for ridge, label, mse, r2 in found.scores:
        errors = []
        for fold in range(4):
            train, held = data[data.fold != fold], data[data.fold == fold]
            a = np.column_stack([np.ones(len(train)), train[["x", "z", "both"]]])
            w = np.linalg.lstsq(a.T @ a + ridge * np.diag([0, 1, 1, 1]), a.T @ train[label], rcond=None)[0]
            errors.append(held[label] - np.column_stack([np.ones(len(held)), held[["x", "z", "both"]]]) @ w)
        squared = np.concatenate(errors) ** 2
        assert mse == pytest.approx(squared.mean(), abs=1e-9)
        if label == "y":
            assert r2 == pytest.approx(1 - squared.mean() / data[label].var(ddof=0))
    best = max(ridges, key=lambda r: np.mean([s[3] for s in found.scores if s[0] == r]))
    assert found.ridge == best
    same = fit_linear(rows, ["x", "z", "both"], ["y", "flat"], ridge=best)
    assert found.model.predictor()(data[["x", "z", "both"]].to_numpy()) == pytest.approx(
        same.predictor()(data[["x", "z", "both"]].to_numpy()), abs=1e-7)


def test_cross_validation_refuses(spark, rows):
    with pytest.raises(ValueError, match="penalty"):
        fit_linear_cv(rows, ["x"], ["y1"], [])
    with pytest.raises(ValueError, match="two folds"):
        fit_linear_cv(rows.limit(1), ["x"], ["y1"], [1.0])
    with pytest.raises(ValueError, match="no rows"):
        fit_linear_cv(rows.limit(0), ["x"], ["y1"], [1.0])
    with pytest.raises(ValueError, match="null"):
        fit_linear(rows.withColumn("x", F.when(F.col("x") > 0, F.col("x"))), ["x"], ["y1"])
