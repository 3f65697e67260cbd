"""Score and prediction files of many model runs as tables labelled by run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from strataframe.functions.scalar import run_tag
from strataframe.session import hadoop_fs
from strataframe.sources.files import ingest_csv

SCORE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("r2", T.DoubleType())])


def load_scores(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Per-column R2 sidecars of several runs -> (run, tag, column, r2).

    `paths` maps a unique run name to a Parquet sidecar. Tags may repeat, run names cannot.
    """
    parts = [
        spark.read.schema(SCORE_SCHEMA).parquet(path)
        .select(F.lit(run).alias("run"), run_tag(F.input_file_name()).alias("tag"), "column", "r2")
        for run, path in paths.items()]
    return _union(parts)


def load_predictions(spark: SparkSession, paths: Mapping[str, str],
                     schema: T.StructType) -> dict[str, DataFrame]:
    """Submission CSV of each run; exactly one per run directory."""
    frames = {}
    for run, path in paths.items():
        fs, glob = hadoop_fs(spark, f"{path.rstrip('/')}/submission*")
        found = fs.globStatus(glob) or []
        if len(found) != 1:
            raise ValueError(f"run {run!r} has {len(found)} submission tables, not one")
        frames[run] = ingest_csv(spark, found[0].getPath().toString(), schema)
    return frames


def long_predictions(frames: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """Wide predictions of several runs -> (run, sample_id, column, pred)."""
    parts = []
    for run, df in frames.items():
        names = [c for c in df.columns if c != id_col]
        parts.append(df.unpivot([id_col], names, "column", "pred")
                     .select(F.lit(run).alias("run"), id_col, "column", "pred"))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
