"""What the operators of this subpackage share: inputs, splits by id, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.session import scratch_path


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, unless their Python path has it already."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_strataframe_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="strataframe-")) / "strataframe.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((root / "strataframe").rglob("*.py")):
            z.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._strataframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_bucket(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; a null id counts as the empty text."""
    value = F.col(f"`{id_col}`") if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % buckets


def texts(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(_id, _text, more): null text becomes empty, and no other column of `df` can clash."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("_id"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), *more)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a worker holds as Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
