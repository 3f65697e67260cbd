from pyspark.sql import functions as F

from strataframe.functions.scalar import run_tag, sample_number, year_index
from strataframe.operators.frame import natural_order
from strataframe.schema import (
    ATMOSPHERE, CLOSED_FORM, NON_NEGATIVE, SAMPLES_PER_YEAR, UNUSED_LABELS, family_columns, resolve_targets)


def test_widths():
    assert len(ATMOSPHERE.input_columns) == 556
    assert len(ATMOSPHERE.label_columns) == 368
    assert len(ATMOSPHERE.raw_struct()) == 925
    assert ATMOSPHERE.label_columns[8:10] == ["ptend_t_0", "ptend_t_1"]
    labels = set(ATMOSPHERE.label_columns)
    assert set(CLOSED_FORM) | set(NON_NEGATIVE) | set(UNUSED_LABELS) <= labels
    assert set(CLOSED_FORM.values()) <= set(ATMOSPHERE.input_columns)


def test_family_order_is_numeric():
    columns = ["v_10", "v_2", "v_0", "v_1", "v_x", "vv_1", "v"]
    assert family_columns(columns, "v") == ["v_0", "v_1", "v_2", "v_10"]


def test_resolve_targets():
    columns = ["a", "v_1", "v_0"]
    assert resolve_targets(columns, ["v", "a", "gone"]) == ["v_0", "v_1", "a"]


def test_ids(spark):
    ids = ["train_0", "train_1441645", "train_1441646", "none", "", None]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    rows = df.select(sample_number(F.col("s")), year_index(F.col("s"), SAMPLES_PER_YEAR)).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (1441645, 0), (1441646, 1), (None, None), (None, None), (None, None)]


def test_run_tag(spark):
    df = spark.createDataFrame([("../output/exp135a/run0/",), ("exp12a",), (None,)], "p string")
    assert [r[0] for r in df.select(run_tag(F.col("p"))).collect()] == ["exp135a", None, None]


def test_natural_order(spark):
    names = ["b_1", "a_10", "a_2", "a", "a_1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in natural_order(df, "n").collect()] == ["a", "a_1", "a_2", "a_10", "b_1"]
