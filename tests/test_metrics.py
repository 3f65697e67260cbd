import pytest
from pyspark.sql import functions as F

from strataframe.operators.ensemble import ensemble_top_k, select_runs
from strataframe.operators.metrics import (
    best_epoch, broken_columns, column_mask, compare_runs, error_share, huber_loss, long_pairs, r2_by_column,
    r2_summary, top_k, worst_samples)
from strataframe.operators.post import (
    apply_weights, clip_columns, evaluation_table, fill_broken, override_closed_form, post_process)


def pairs(spark, **columns):
    rows = [(c, float(y), float(p)) for c, (ys, ps) in columns.items() for y, p in zip(ys, ps)]
    return spark.createDataFrame(rows, "column string, y double, pred double")


@pytest.fixture(scope="module")
def scored(spark):
    return pairs(spark, good=([1, 2, 3], [1, 2, 4]), mean=([1, 2, 3], [2, 2, 2]), masked=([1, 2, 3], [9, 9, 9]),
                 const_ok=([5, 5], [5, 5]), const_bad=([5, 5], [5, 6]))


@pytest.fixture(scope="module")
def mask(spark):
    weights = spark.createDataFrame(
        [("good", 1.0), ("mean", 2.0), ("masked", 0.0), ("const_ok", 1.0), ("const_bad", 1.0)],
        "column string, weight double")
    return column_mask(weights)


def test_r2(scored):
    r2 = {r["column"]: r["r2"] for r in r2_by_column(scored).collect()}
    assert r2["good"] == pytest.approx(0.5) and r2["mean"] == pytest.approx(0)
    assert r2["const_ok"] == 1 and r2["const_bad"] == 0 and r2["masked"] < -10


def test_summary(scored, mask):
    r2 = r2_by_column(scored)
    row = r2_summary(r2, mask).first()
    assert row["val_r2"] == pytest.approx((0.5 + 0 + 1 + 1 + 0) / 5) and row["r2_broken"] == 2
    assert {r["column"] for r in broken_columns(r2, mask).collect()} == {"mean", "const_bad"}
    assert r2_summary(r2).first()["r2_broken"] == 3


def test_huber(spark, scored, mask):
    assert huber_loss(scored.filter("column = 'good'")).first()[0] == pytest.approx(0.5 / 3)
    far = pairs(spark, x=([0.0], [3.0]))
    assert huber_loss(far).first()[0] == pytest.approx(2.5)
    kept = huber_loss(scored, mask=mask).first()[0]
    assert kept == pytest.approx((0.5 + 0.5 + 0 + 0.5 + 0.5) / 10)


def test_unused_columns(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0)], "column string, weight double")
    kept = {r["column"]: r["keep"] for r in column_mask(weights, ["b"]).collect()}
    assert kept == {"a": True, "b": False, "c": False}


def test_best_epoch_takes_later_tie(spark):
    r2 = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.9), (3, "a", 0.9)], "epoch int, column string, r2 double")
    assert [r["epoch"] for r in best_epoch(r2, "epoch").collect()] == [3]


def test_error_shares_sum_to_one(spark):
    df = spark.createDataFrame([(f"s{i}", float(i), 0.0) for i in range(20)], "sample_id string, p double, p_label double")
    shares = error_share(df, "p", "p_label")
    assert shares.agg(F.sum("diff_ratio")).first()[0] == pytest.approx(1)
    assert [r["sample_id"] for r in worst_samples(shares, 2, "sample_id").collect()] == ["s19", "s18"]
    exact = error_share(df.withColumn("p", F.lit(0.0)), "p", "p_label")
    assert exact.filter("diff_ratio IS NOT NULL").count() == 0


def test_compare_runs(spark):
    a = spark.createDataFrame([("v_10", 0.5), ("v_2", -7.0)], "column string, r2 double")
    b = spark.createDataFrame([("v_2", 0.1), ("v_10", 0.2)], "column string, r2 double")
    assert [tuple(r) for r in compare_runs(a, b).collect()] == [("v_2", -1, 0.1), ("v_10", 0.5, 0.2)]


@pytest.fixture(scope="module")
def runs(spark):
    def run(offset, extra=0.0):
        return spark.createDataFrame([(f"s{i}", i + offset, i * offset + extra) for i in range(3)],
                                     "sample_id string, a double, b double")
    return {"r1": run(1.0), "r2": run(2.0), "r3": run(3.0), "r4": run(4.0, 1.0)}


@pytest.fixture(scope="module")
def scores(spark):
    rows = [("r1", "a", 0.9), ("r2", "a", 0.8), ("r3", "a", 0.8), ("r4", "a", 0.7)]
    rows += [(r, "b", s) for r, s in (("r1", -1.0), ("r2", 0.0), ("r3", None), ("r4", float("nan")))]
    return spark.createDataFrame(rows, "run string, column string, r2 double")


def test_top_k_ties(scores):
    assert [(r["run"], r["rank"]) for r in top_k(scores, 2).orderBy("rank").collect()] == [("r1", 1), ("r2", 2)]
    assert select_runs(scores, ["a", "b"], 3, "r4") == {"a": ["r1", "r2", "r3"], "b": ["r4"]}


def test_ensemble(runs, scores):
    out = ensemble_top_k(scores, runs, ["b", "a"]).orderBy("sample_id")
    assert out.columns == ["sample_id", "b", "a"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 2), (5, 3), (9, 4)]


def test_ensemble_skips_nulls(spark, runs, scores):
    holed = dict(runs, r2=runs["r2"].withColumn("a", F.lit(None).cast("double")))
    out = ensemble_top_k(scores, holed, ["a"], k=3).orderBy("sample_id").collect()
    assert [r["a"] for r in out] == [2, 3, 4]


STATS = {c: dict(mean=10.0, std=2.0, q1=0.0, q2=0.0, q3=0.0, min=0.0, max=0.0, std_y=1.0, **{"lambda": 1.0})
         for c in ("a", "b", "v_0", "v_1")}


def test_post_process(spark):
    preds = spark.createDataFrame([("s1", 1.0, -9.0, 1.0, 2.0), ("s2", 0.0, 0.0, 1.0, 2.0)],
                                  "sample_id string, a double, b double, v_0 double, v_1 double")
    inputs = spark.createDataFrame([("s2", 2400.0), ("s1", 1200.0)], "sample_id string, x_0 double")
    out = post_process(preds, {"standard": ["a", "b", "v"], "robust": None}, STATS, broken=["v_1"],
                       means={"v_1": 77.0}, weights={"v_1": 1.0, "v_0": 3.0, "b": 1.0, "a": 0.5},
                       inputs=inputs, clipped=["b"], mapping={"v_0": "x_0"})
    assert out.columns == ["sample_id", "v_1", "v_0", "b", "a"]
    assert {tuple(r) for r in out.collect()} == {("s1", 77, -3, 0, 6), ("s2", 77, -6, 10, 5)}


def test_post_steps(spark):
    df = spark.createDataFrame([("s1", -1.0, 2.0), ("s2", None, 3.0)], "sample_id string, a double, b double")
    assert [r["a"] for r in clip_columns(df, ["a", "none"]).collect()] == [0, None]
    assert [r["b"] for r in fill_broken(df, ["b"], {"b": 9}).collect()] == [9, 9]
    with pytest.raises(ValueError):
        apply_weights(df, {"zz": 1.0})
    inputs = spark.createDataFrame([("s1", 12.0), ("s2", 2400.0)], "sample_id string, x double")
    below = override_closed_form(df, inputs, {"b": "x"}, below=100).orderBy("sample_id").collect()
    assert [r["b"] for r in below] == pytest.approx([-0.01, 3])
    weighted = override_closed_form(df, inputs, {"b": "x"}, weights={"b": 10.0}).orderBy("sample_id").collect()
    assert [r["b"] for r in weighted] == pytest.approx([-0.1, -20])


def test_evaluation_table(spark):
    labels = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "sample_id string, a double")
    preds = spark.createDataFrame([("s2", 5.0), ("s1", 4.0)], "sample_id string, a double")
    table = evaluation_table(labels, preds, ["a"])
    assert table.columns == ["sample_id_label", "a_label", "a"]
    long = long_pairs(table, ["a"], "sample_id_label")
    assert {tuple(r) for r in long.collect()} == {("s1", "a", 1, 4), ("s2", "a", 2, 5)}


def test_post_process_needs_clipped_columns(spark):
    df = spark.createDataFrame([("s", -1.0)], "sample_id string, a double")
    with pytest.raises(ValueError, match="absent"):
        clip_columns(df, ["a", "absent"], on_absent="error")
    with pytest.raises(ValueError, match="absent"):
        post_process(df, {}, STATS, [], {}, {"a": 1.0}, clipped=["absent"])
    with pytest.raises(ValueError, match="on_absent"):
        clip_columns(df, ["a"], on_absent="maybe")
