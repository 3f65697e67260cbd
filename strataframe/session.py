"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Without this every Column call in Python walks the stack, which adds up at a thousand columns.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Wide rows make large batches; keep the Arrow buffers of Python tasks small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app_name: str = "strataframe", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the defaults above; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir` of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return "file://" + tempfile.gettempdir() + "/strataframe"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{_shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    fs, hadoop_path = hadoop_fs(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def hadoop_fs(spark: SparkSession, path: str):
    """The file system that serves `path`, and the path as it names it."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hadoop_path
