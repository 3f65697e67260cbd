"""CSV and Parquet scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from strataframe.session import hadoop_fs


def ingest_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Splittable scan of a headed CSV with a given schema; malformed rows stop the job."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("enforceSchema", False).csv(path))


def csv_to_parquet(spark: SparkSession, src, dst: str, schema: T.StructType,
                   if_exists: str = "skip") -> None:
    write_parquet(ingest_csv(spark, src, schema), dst, if_exists, dictionary=False)


def scan_columns(spark: SparkSession, path, schema: T.StructType, columns: Sequence[str]) -> DataFrame:
    """CSV scan that parses only the named columns."""
    return ingest_csv(spark, path, schema).select(*columns)


def header(spark: SparkSession, path) -> list[str]:
    """Column names of a headed CSV; reads one line."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def first_row_long(df: DataFrame, id_col: str, order: Sequence[str] | None = None,
                   value_name: str = "weight") -> DataFrame:
    """First row of a wide table as (column, value): a weight per label.

    A file's own first row without `order`, the row with the smallest `order` with it.
    """
    row = (df.orderBy(*order) if order else df).limit(1)
    names = [c for c in df.columns if c != id_col]
    return row.select(*names).unpivot([], names, "column", value_name)


def scan_parquet(spark: SparkSession, paths, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan over one or more globs, columns pruned at the reader."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether an earlier job finished writing here. A job that died leaves no success mark."""
    fs, _ = hadoop_fs(spark, path)
    return fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an output folder, if there is one."""
    fs, folder = hadoop_fs(spark, path)
    fs.delete(folder, True)


def write_parquet(df: DataFrame, path: str, if_exists: str = "skip",
                  partition_by: Sequence[str] = (), dictionary: bool = True, rows_per_file: int = 0) -> bool:
    """Parquet sink. `skip` keeps finished output and replaces what a failed job left behind.

    Switch `dictionary` off for tables of measured values: they hardly repeat, and building
    dictionaries for a thousand columns costs time and space. A task starts another file after
    `rows_per_file` rows, if given. Returns whether anything was written.
    """
    if if_exists not in ("skip", "overwrite"):
        raise ValueError(f"if_exists is 'skip' or 'overwrite', not {if_exists!r}")
    if if_exists == "skip" and is_complete(df.sparkSession, path):
        return False
    limit = {"maxRecordsPerFile": rows_per_file} if rows_per_file else {}
    (df.write.mode("overwrite").partitionBy(*partition_by).options(**limit)
     .option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path))
    return True


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Headed CSV with a fixed column order; every column must exist."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns missing from the result: {absent}")
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
