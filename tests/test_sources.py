import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from strataframe.session import scratch_path
from strataframe.sources.files import first_row_long, header, ingest_csv, is_complete, write_csv, write_parquet
from strataframe.sources.runs import load_predictions, long_predictions

SCHEMA = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("a", T.DoubleType())])


def rows(spark, *values):
    return spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(values)], SCHEMA)


def test_csv_roundtrip_and_header(spark, tmp_path):
    path = str(tmp_path / "x")
    write_csv(rows(spark, 0.1, 1e-300, None), path, ["a", "sample_id"])
    assert header(spark, path) == ["a", "sample_id"]
    schema = T.StructType([SCHEMA["a"], SCHEMA["sample_id"]])
    assert [r["a"] for r in ingest_csv(spark, path, schema).orderBy("sample_id").collect()] == [0.1, 1e-300, None]
    with pytest.raises((PySparkException, Py4JJavaError), match="FAILED_READ_FILE|MALFORMED"):
        ingest_csv(spark, path, SCHEMA).collect()
    with pytest.raises(ValueError, match="zz"):
        write_csv(rows(spark, 1.0), path, ["zz"])


def test_malformed_rows_stop(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("sample_id,a\ns1,1.5\ns2,oops\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="FAILED_READ_FILE|MALFORMED"):
        ingest_csv(spark, str(path), SCHEMA).collect()


def test_skip_replaces_unfinished_output(spark, tmp_path):
    path = str(tmp_path / "out")
    assert write_parquet(rows(spark, 1.0), path) is True
    assert is_complete(spark, path)
    assert write_parquet(rows(spark, 2.0), path) is False
    (tmp_path / "out" / "_SUCCESS").unlink()
    assert write_parquet(rows(spark, 3.0), path) is True
    assert spark.read.parquet(path).first()["a"] == 3.0
    with pytest.raises(ValueError):
        write_parquet(rows(spark, 1.0), path, "append")


def test_first_row(spark):
    wide = spark.createDataFrame([("s1", 2.0, 3.0), ("s0", 4.0, 5.0)], "sample_id string, a double, b double")
    out = first_row_long(wide, "sample_id", ["sample_id"]).collect()
    assert {(r["column"], r["weight"]) for r in out} == {("a", 4.0), ("b", 5.0)}


def test_one_submission_per_run(spark, tmp_path):
    run = str(tmp_path / "exp001a")
    write_csv(rows(spark, 1.0, 2.0), f"{run}/submission_1", SCHEMA.names)
    frames = load_predictions(spark, {"r": run}, SCHEMA)
    assert long_predictions(frames, "sample_id").agg(F.sum("pred")).first()[0] == 3
    write_csv(rows(spark, 1.0), f"{run}/submission_2", SCHEMA.names)
    with pytest.raises(ValueError, match="2 submission"):
        load_predictions(spark, {"r": run}, SCHEMA)


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
