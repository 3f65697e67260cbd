import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strataframe.operators.joins import attach_by_key, hot_keys, lookup_join, tiered_lookup_join
from strataframe.plans.prepare import feature_table


def lookup_rows(spark, *rows):
    data = [(k, loc, lat, lon, ts) for k, loc, ts, lat, lon in rows]
    df = spark.createDataFrame(data, "key double, location long, lat double, lon double, ts string")
    return df.select("key", "location", F.to_timestamp_ntz("ts").alias("timestamp"), "lat", "lon")


@pytest.fixture(scope="module")
def lookup(spark):
    return lookup_rows(
        spark, (1.0, 1, "2001-01-02 08:00:00", 10.0, 20.0), (2.0, 2, "2001-03-01 01:20:00", 11.0, 21.0),
        (3.0, 3, "2001-12-31 23:40:00", 12.0, 22.0), (4.001, 4, "2001-05-05 16:00:00", 13.0, 23.0),
        (5.1, 5, "2001-06-06 00:00:00", 14.0, 24.0), (7.001, 7, "2001-07-07 05:00:00", 15.0, 25.0))


def probe(spark, *keys):
    return spark.createDataFrame([(f"train_{i}", k) for i, k in enumerate(keys)], "sample_id string, key double")


def slots(df):
    return df.filter(F.hour("timestamp").isin(0, 8, 16) & (F.minute("timestamp") == 0))


TIERS = [(None, None), (2, slots), (0, slots)]


def test_exact(spark, lookup):
    rows = lookup_join(probe(spark, 1.0, 3.0, 1.0), lookup, "key").orderBy("sample_id").collect()
    assert [r["location"] for r in rows] == [1, 3, 1]


def test_miss(spark, lookup):
    with pytest.raises(PySparkException, match="no lookup row"):
        lookup_join(probe(spark, 1.0, 9.0), lookup, "key").collect()
    kept = lookup_join(probe(spark, 1.0, 9.0, None), lookup, "key", on_miss="keep").collect()
    assert sorted(r["location"] or 0 for r in kept) == [0, 0, 1]


def test_guards_survive_pruning(spark, lookup):
    twice = lookup.unionByName(lookup_rows(spark, (1.0, 9, "2000-01-01 00:00:00", 0.0, 0.0), (9.0, 1, "2000-01-01 00:00:00", 0.0, 0.0)))
    twice = twice.unionByName(lookup_rows(spark, (9.0, 2, "2000-01-01 00:00:00", 0.0, 0.0)))
    for join in (lambda df, rows: lookup_join(df, rows, "key"), lambda df, rows: tiered_lookup_join(df, rows, "key", TIERS[:1])):
        for df in (probe(spark, 1.0, 8.0), probe(spark, 3.0, None)):
            for read in (lambda out: out.count(), lambda out: out.select("sample_id").collect()):
                with pytest.raises(PySparkException, match="no lookup row"):
                    read(join(df, lookup))
        with pytest.raises(PySparkException, match="more than one row"):
            join(probe(spark, 1.0), twice).count()
        # Rows of the lookup that no sample meets may be ambiguous.
        assert len(join(probe(spark, 3.0), twice).collect()) == 1


def test_more_hot_keys_than_fit_a_list(spark, lookup, monkeypatch):
    df = spark.range(4000).select(F.concat(F.lit("s_"), "id").alias("sample_id"), (F.col("id") % 8 + 1).cast("double").alias("key"))
    assert len(hot_keys(df, "key", 100)) == 8
    monkeypatch.setattr("strataframe.operators.joins.MAX_HOT", 4)
    # No key holds a fourth of the rows: none is hot, and none is dropped.
    assert hot_keys(df, "key", 100) == []
    assert lookup_join(df, lookup, "key", on_miss="keep", min_hot_rows=100).count() == 4000


def test_duplicate(spark, lookup):
    twice = lookup.unionByName(lookup_rows(spark, (1.0, 9, "2000-01-01 00:00:00", 0.0, 0.0)))
    assert lookup_join(probe(spark, 3.0), twice, "key").count() == 1
    with pytest.raises(PySparkException, match="more than one row"):
        lookup_join(probe(spark, 1.0), twice, "key").collect()
    first = lookup_join(probe(spark, 1.0), twice, "key", on_duplicate="first").first()
    assert first["location"] == 9


def test_tiers(spark, lookup):
    """Three exact, one at two digits, one at none; the key of a coarse match stays as it is."""
    df = probe(spark, 1.0, 2.0, 3.0, 4.0011, 5.3)
    out = tiered_lookup_join(df, lookup, "key", TIERS).orderBy("sample_id").collect()
    assert [(r["location"], r["match_tier"]) for r in out] == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)]
    assert out[3]["key"] == 4.0011


def test_tier_filter_and_miss(spark, lookup):
    """7.0011 rounds to a lookup key, but that row is outside the time slots."""
    df = probe(spark, 7.0011, 1.0)
    with pytest.raises(PySparkException, match="no lookup row"):
        tiered_lookup_join(df, lookup, "key", TIERS).collect()
    out = tiered_lookup_join(df, lookup, "key", TIERS, on_miss="keep").orderBy("sample_id").collect()
    assert [(r["location"], r["match_tier"]) for r in out] == [(None, None), (1, 1)]


def test_tier_duplicates(spark, lookup):
    twice = lookup.unionByName(lookup_rows(spark, (4.002, 8, "2001-04-04 16:00:00", 0.0, 0.0)))
    df = probe(spark, 4.0013)
    with pytest.raises(PySparkException, match="more than one row"):
        tiered_lookup_join(df, twice, "key", TIERS).collect()
    out = tiered_lookup_join(df, twice, "key", TIERS, on_duplicate="first").first()
    assert (out["location"], out["match_tier"]) == (8, 2)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_hot_keys(spark, lookup, adaptive):
    """A third of the rows share one key, a third have none, many distinct keys round alike."""
    keys = (F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, F.lit(None).cast("double"))
            .otherwise(4.0 + F.col("id") / 1e7))
    df = spark.range(3000).select(F.concat(F.lit("s_"), "id").alias("sample_id"), keys.alias("key"))
    assert sorted(hot_keys(df, "key", 100), key=str) == [(1.0, 10), (None, 10)]
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for min_hot in (100, 10_000):
            out = tiered_lookup_join(df, lookup, "key", TIERS, on_miss="keep", min_hot_rows=min_hot)
            counts = {r["match_tier"]: (r["n"], r["d"]) for r in out.groupBy("match_tier").agg(
                F.count("*").alias("n"), F.countDistinct("sample_id").alias("d")).collect()}
            assert counts == {1: (1000, 1000), None: (1000, 1000), 2: (1000, 1000)}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tiers_shuffle_little(spark, lookup):
    """All tiers share one join; only the rows themselves and their distinct keys move besides."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tiered_lookup_join(probe(spark, 1.0, 4.0011), lookup, "key", TIERS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 6


def test_only_null_keys_are_hot(spark, lookup):
    df = spark.range(500).select(
        F.concat(F.lit("s_"), "id").alias("sample_id"), F.when(F.col("id") == 0, 1.0).alias("key"))
    assert hot_keys(df, "key", 100) == [(None, 5)]
    out = lookup_join(df, lookup, "key", on_miss="keep", min_hot_rows=100)
    assert out.count() == 500 and out.filter("location = 1").count() == 1


def test_empty_probe(spark, lookup):
    assert tiered_lookup_join(probe(spark, 1.0).limit(0), lookup, "key", TIERS).count() == 0


def test_attach(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, x int")
    right = spark.createDataFrame([("b", 3), ("a", 4)], "sample_id string, y int")
    assert {tuple(r) for r in attach_by_key(left, right).collect()} == {("a", 1, 4), ("b", 2, 3)}
    with pytest.raises(ValueError):
        attach_by_key(left, left)
    with pytest.raises(ValueError):
        attach_by_key(left, right, on_miss="ignore")
    more = left.unionByName(spark.createDataFrame([("c", 5), (None, 6)], "sample_id string, x int"))
    with pytest.raises(PySparkException, match="no right side row"):
        attach_by_key(more, right).count()
    assert attach_by_key(more, right, on_miss="drop").count() == 2
    assert attach_by_key(more, right, on_miss="keep").filter("y is null").count() == 2
    twice = right.unionByName(spark.createDataFrame([("a", 9), ("z", 1), ("z", 1)], "sample_id string, y int"))
    with pytest.raises(PySparkException, match="more than one row"):
        attach_by_key(left, twice).count()
    assert attach_by_key(left, twice, on_duplicate="keep").count() == 3


def test_features(spark, lookup):
    train = feature_table(probe(spark, 1.0, 3.0), lookup, key="key").orderBy("sample_id").collect()
    assert [tuple(r)[2:] for r in train] == [(1, 10.0, 20.0, 0, 1, 8, 2), (3, 12.0, 22.0, 0, 12, 23, 365)]
    test = feature_table(probe(spark, 1.0), lookup, is_test=True, key="key").first()
    assert test["year"] == 7
