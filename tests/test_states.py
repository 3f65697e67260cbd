"""States of batches, merged and added to, against the statistics of all rows at once."""

import pytest
from pyspark.sql import functions as F

from strataframe.functions.scaling import STAT_NAMES
from strataframe.operators import states
from strataframe.operators.states import add_states, batch_states, merge_states, read_states
from strataframe.operators.stats import column_stats
from strataframe.plans.prepare import statistics_phase
from strataframe.schema import ProfileSchema

COLUMNS = ["a", "far", "holed", "none", "low"]


@pytest.fixture(scope="module")
def rows(spark):
    a = F.sin(F.col("id") * 1.7) * (1 + F.col("id") % 7)
    return spark.range(2000).repartition(7, "id").select(
        "id", F.floor(F.col("id") / 130).alias("batch_id"), a.alias("a"), (a + 1e9).alias("far"),
        F.when(F.col("id") > 300, a).alias("holed"), F.lit(None).cast("double").alias("none"), (-F.abs(a)).alias("low"))


def same(found, want):
    found, want = ({r["column"]: r for r in df.collect()} for df in (found, want))
    assert found.keys() == want.keys()
    for column, row in want.items():
        for name in STAT_NAMES:
            if row[name] is None:
                assert found[column][name] is None
            elif name in ("q1", "q2", "q3"):
                assert found[column][name] == pytest.approx(row[name], abs=0.3)
            else:
                # Means near 1e9 are rounded at 1e-7, which a spread of 3 shows in its ninth digit; raw sums of squares would keep none.
                assert found[column][name] == pytest.approx(row[name], rel=1e-8), (column, name)


def test_merged_states_equal_one_pass(rows):
    same(merge_states(batch_states(rows, COLUMNS, chunk=2)), column_stats(rows, COLUMNS, "exact"))


def test_states_are_added(spark, rows, tmp_path):
    path = str(tmp_path / "states")
    assert add_states(rows.filter("batch_id < 4"), path, COLUMNS) == 4
    # Values of known batches do not matter any more, only their numbers.
    changed = rows.withColumn("a", F.when(F.col("batch_id") < 4, F.lit(1e12)).otherwise(F.col("a")))
    assert add_states(changed, path, COLUMNS) == 12
    assert add_states(changed, path, COLUMNS) == 0
    states = read_states(spark, path)
    assert states.count() == 16 * len(COLUMNS)
    same(merge_states(states), column_stats(rows, COLUMNS, "exact"))
    same(merge_states(states.filter("batch_id <> 3")), column_stats(rows.filter("batch_id <> 3"), COLUMNS, "exact"))
    with pytest.raises(ValueError, match="other columns"):
        add_states(rows, path, COLUMNS[:2])
    with pytest.raises(ValueError, match="without"):
        add_states(rows.withColumn("batch_id", F.lit(None).cast("long")), str(tmp_path / "x"), COLUMNS)


@pytest.mark.parametrize("most", [1, 1000])
def test_additions_are_few_folders(spark, rows, tmp_path, monkeypatch, most):
    """Folders grow with the additions, not with the batches; the rest of a stopped addition does not count."""
    monkeypatch.setattr(states, "MOST_NAMED", most)
    path = tmp_path / "states"
    assert add_states(rows.filter("batch_id % 2 = 0"), str(path), COLUMNS) == 8
    assert len([p for p in path.iterdir() if p.is_dir()]) == 1
    # A run that was killed has left rows without a success mark.
    batch_states(rows.filter("batch_id = 1"), COLUMNS).write.parquet(str(path / "added-000002"))
    (path / "added-000002" / "_SUCCESS").unlink()
    assert read_states(spark, str(path)).count() == 8 * len(COLUMNS)
    changed = rows.withColumn("a", F.when(F.col("batch_id") % 2 == 0, F.lit(1e12)).otherwise(F.col("a")))
    assert add_states(changed, str(path), COLUMNS) == 8 and add_states(changed, str(path), COLUMNS) == 0
    assert len([p for p in path.iterdir() if p.is_dir()]) == 2
    found = read_states(spark, str(path))
    assert found.count() == found.select("batch_id", "column").distinct().count() == 16 * len(COLUMNS)
    same(merge_states(found), column_stats(rows, COLUMNS, "exact"))
    with pytest.raises(ValueError, match="without"):
        holed = F.when(F.col("id") != 1999, F.col("batch_id") + 100)
        add_states(rows.withColumn("batch_id", holed), str(path), COLUMNS)


def test_folders_of_single_batches_are_read(spark, rows, tmp_path):
    path = str(tmp_path / "states")
    batch_states(rows.filter("batch_id < 4"), COLUMNS).write.partitionBy("batch_id").parquet(path)
    assert add_states(rows, path, COLUMNS) == 12 and add_states(rows, path, COLUMNS) == 0
    same(merge_states(read_states(spark, path)), column_stats(rows, COLUMNS, "exact"))


def test_no_rows(spark, rows, tmp_path):
    path = str(tmp_path / "none")
    assert add_states(rows.limit(0), path, COLUMNS) == 0
    assert read_states(spark, path) is None
    assert merge_states(batch_states(rows.limit(0), COLUMNS)).count() == 0


def test_phase_with_states(spark, tmp_path):
    schema = ProfileSchema(in_scalars=("s",), in_families=(), out_scalars=("y",), out_families=(), levels=1)
    out = str(tmp_path)
    raw = spark.range(400).select(
        F.concat(F.lit("train_"), "id").alias("sample_id"), F.sin("id").alias("s"), F.cos("id").alias("y"), F.floor(F.col("id") / 50).alias("batch_id"),
        (F.floor(F.col("id") / 50) * 50).alias("start"), (F.floor(F.col("id") / 50) * 50 + 49).alias("end"))
    raw.write.parquet(f"{out}/raw_train")
    for num_val, order in ((0, "numeric"), (3, "numeric"), (2, "lexicographic")):
        found = statistics_phase(spark, out, schema, num_val, "states", order=order).toPandas()
        want = statistics_phase(spark, out, schema, num_val, "exact", order=order).toPandas()
        a, b = (df.set_index("column").sort_index() for df in (found, want))
        plain = ["mean", "std", "min", "max", "lambda", "std_y"]
        assert a[plain].to_numpy() == pytest.approx(b[plain].to_numpy())
        assert a[["q1", "q2", "q3"]].to_numpy() == pytest.approx(b[["q1", "q2", "q3"]].to_numpy(), abs=0.05)
