import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from strataframe.functions.scaling import STAT_NAMES, collect_stats, make_scaler, scale, scale_vector
from strataframe.operators.stats import (
    column_stats, describe, exact_quantiles, long_values, quality_check, quality_report, stats_from_matrix,
    stats_matrix)

METHODS = ["standard", "robust", "minmax", "minmaxmean", "minmaxzero", "exp", "std", "standard_y"]


@pytest.fixture(scope="module")
def hand(spark):
    """[1,2,3,4], a constant column, and a column without positive values."""
    rows = [(1.0, 5.0, -1.0), (2.0, 5.0, 0.0), (3.0, 5.0, None), (4.0, 5.0, -1.0)]
    return spark.createDataFrame(rows, "a double, c double, n double")


@pytest.mark.parametrize("quantile", ["exact", "approx"])
def test_hand_statistics(hand, quantile):
    stats = collect_stats(column_stats(hand, ["a", "c", "n"], quantile, chunk=2))
    a = stats["a"]
    assert a["mean"] == 2.5 and a["min"] == 1 and a["max"] == 4
    assert a["std"] == pytest.approx(1.2909944487)
    assert a["std_y"] == pytest.approx(2.7386127875)
    assert a["lambda"] == pytest.approx(0.4)
    if quantile == "exact":
        assert (a["q1"], a["q2"], a["q3"]) == (1.75, 2.5, 3.25)
    assert stats["c"]["std"] == 0 and stats["c"]["q2"] == 5
    assert stats["n"]["lambda"] == pytest.approx(1e50)


def test_constant_column(hand):
    stats = column_stats(hand, ["c"], "exact")
    forward = scale(hand, {"standard": ["c"]}, stats)
    assert {r["c"] for r in forward.collect()} == {0.0}
    back = scale(forward, {"standard": ["c"]}, stats, reverse=True)
    assert {r["c"] for r in back.collect()} == {5.0}


def test_nulls_stay_null(hand):
    stats = column_stats(hand, ["n"], "exact")
    assert scale(hand, {"standard": ["n"]}, stats).filter("n IS NULL").count() == 1


def test_unknown_method(hand):
    with pytest.raises(NotImplementedError):
        scale(hand, {"log": ["a"]}, column_stats(hand, ["a"], "exact"))


def test_empty_and_single_row(spark, hand):
    empty = collect_stats(column_stats(hand.filter("a > 9"), ["a"], "exact"))
    assert empty == {}
    single = collect_stats(column_stats(hand.filter("a = 3"), ["a"], "exact"))["a"]
    assert single["std"] is None and single["q1"] == single["q3"] == 3


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    for quantile in ("exact", "approx"):
        stats = collect_stats(column_stats(df, ["x"], quantile))["x"]
        assert stats["mean"] is None and stats["q2"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50, allow_subnormal=False), min_size=2, max_size=15, unique=True))
def test_roundtrip_property(spark, values):
    rows = spark.createDataFrame([tuple([v / 50] * len(METHODS)) for v in values],
                                 ", ".join(f"{m} double" for m in METHODS))
    stats = collect_stats(column_stats(rows, METHODS, "exact"))
    # The exponential scaler only keeps digits while rate * x is moderate.
    stats["exp"]["lambda"] = 0.5
    methods = {m: [m] for m in METHODS}
    back = scale(scale(rows, methods, stats), methods, stats, reverse=True)
    for row, v in zip(back.collect(), values):
        for m in METHODS:
            assert row[m] == pytest.approx(v / 50, abs=1e-9)


def test_vector_matches_columns(spark, hand):
    stats = collect_stats(column_stats(hand, ["a", "c"], "exact"))
    for method in METHODS:
        wide = scale(hand, {method: ["a", "c"]}, stats).select("a", "c").collect()
        levels = [stats["a"], stats["c"]]
        packed = hand.select(scale_vector("array(a, c)", method, levels).alias("v"))
        packed = packed.select("v", scale_vector("v", method, levels, reverse=True).alias("back")).collect()
        for w, p in zip(wide, packed):
            assert p["v"] == pytest.approx(list(w))
        if method != "exp":
            assert [p["back"][0] for p in packed] == pytest.approx([1, 2, 3, 4])


def test_exp_reverse_outside_domain(spark):
    scaler = make_scaler("exp", {n: 1.0 for n in STAT_NAMES})
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    out = [r[0] for r in df.selectExpr(scaler.reverse("x")).collect()]
    assert out[0] == 0 and out[1] == math.inf and math.isnan(out[2])


def test_exact_quantiles_with_brackets(spark):
    """More values than the sketch keeps, a third of them equal."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0.25).otherwise((F.col("id") * 7919 % 60_013) / 60_013).alias("x"))
    probs = (0.0, 0.01, 0.25, 0.3, 0.5, 0.9, 1.0)
    ours = {r["prob"]: r["value"] for r in exact_quantiles(long_values(df, ["x"]), probs, accuracy=2000).collect()}
    spark_exact = df.agg(F.percentile("x", list(probs)).alias("p")).first()["p"]
    assert [ours[p] for p in probs] == pytest.approx(spark_exact, abs=1e-12)


def test_approx_is_close(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021).cast("double").alias("x"))
    s = collect_stats(column_stats(df, ["x"]))["x"]
    for name, want in (("q1", 12_505), ("q2", 25_010), ("q3", 37_515)):
        assert abs(s[name] - want) < 300


def test_matrix_roundtrip(spark, hand):
    stats = column_stats(hand, ["a", "c"], "exact")
    matrix = stats_matrix(stats, ["a", "c"])
    assert [r["stats"] for r in matrix.collect()] == [
        "mean", "std", "q1_4", "q2_4", "q3_4", "min", "max", "lambda", "std_y"]
    assert matrix.columns == ["stats", "a", "c"]
    assert collect_stats(stats_from_matrix(matrix)) == collect_stats(stats)


def test_quality(spark, hand):
    bad = hand.withColumn("d", F.when(F.col("a") == 1, float("nan")).when(F.col("a") == 2, float("-inf")).otherwise(0.0))
    report = {r["column"]: r.asDict() for r in quality_report(bad).collect()}
    assert report["a"] == dict(column="a", rows=4, null_count=0, nan_count=0, infinite_count=0)
    assert report["n"]["null_count"] == 1
    assert (report["d"]["nan_count"], report["d"]["infinite_count"]) == (1, 1)
    quality_check(hand, 4, ["a", "c"])
    with pytest.raises(ValueError, match="n"):
        quality_check(hand, 4)
    with pytest.raises(ValueError, match="5 rows"):
        quality_check(hand, 5, ["a"])
    with pytest.raises(ValueError, match="missing"):
        quality_check(hand, 4, ["zz"])
    assert quality_report(hand.filter("a > 9")).first()["rows"] == 0


def test_describe(spark, hand):
    d = describe(hand, "n").first()
    assert (d["count"], d["null_count"], d["min"], d["p50"], d["max"]) == (3, 1, -1, -1, 0)
