"""Vectors as the searches take them: packed, checked, equal ones collapsed to one with their smallest ids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import ship, written


def unpack(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """A column of packed vectors as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.zeros((0, 1), kind)


def _packed(batches: Iterator[pa.RecordBatch], dim: int, kind: str, scale: float, nonzero: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, packed = [], []
        for name, v in zip(batch.column("_id").to_pylist(), batch.column("_v")):
            values = v.values if v.is_valid else None
            if values is None or len(values) != dim or values.null_count:
                continue
            x = values.to_numpy().astype(np.float64)
            if not np.isfinite(x).all() or nonzero and not x.any():
                continue
            # Adding zero makes both zeros equal.
            x = np.floor(scale * x) if kind == "<i8" else x + 0.0
            if kind == "<i8" and np.abs(x).max() >= 2.0 ** 62:
                raise ValueError(f"a component of vector {name} does not fit 64 bits")
            ids.append(name)
            packed.append(x.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["_id", "_x"])


@dataclass(frozen=True)
class Distinct:
    """`vectors` (_gid, _x): each different vector once, named by its smallest id. `members` (_id, _gid):
    every row. `least` (_gid, _ids): the smallest ids of each vector, as many as a search can return."""

    vectors: DataFrame
    members: DataFrame
    least: DataFrame
    dim: int


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, keep: int, kind: str = "<f8", scale: float = 1.0,
                     nonzero: bool = True) -> Distinct:
    """Packs and collapses the vectors of a table.

    Vectors that are null, of other length than most, or hold null or non-finite components take no
    part, nor do rows without an id, nor zero vectors where `nonzero`. Equal vectors score alike, so
    only the `keep` smallest ids of each can be among the results.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector_col}`").alias("_v")).filter("_id is not null and _v is not null")
    sizes = rows.groupBy(F.size("_v").alias("n")).agg(F.count("*").alias("c")).filter("n > 0").orderBy(F.desc("c"), F.desc("n")).first()
    dim = sizes["n"] if sizes else 0
    run = partial(_packed, dim=dim, kind=kind, scale=scale, nonzero=nonzero)
    packed = written(rows.mapInArrow(run, "_id long, _x binary").withColumn("_h", F.xxhash64("_x")), "packed")
    vectors = written(packed.groupBy("_h", "_x").agg(F.min("_id").alias("_gid")), "vectors")
    members = written(packed.join(vectors, ["_h", "_x"]).select("_id", "_gid"), "members")
    place = F.row_number().over(Window.partitionBy("_gid").orderBy("_id"))
    least = (members.distinct().withColumn("_n", place).filter(F.col("_n") <= keep).groupBy("_gid")
             .agg(F.sort_array(F.collect_list("_id")).alias("_ids")))
    return Distinct(vectors.select("_gid", "_x"), members, least, dim)


def answers(found: DataFrame, data: Distinct, query: Column | str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (_qgid, _gid, _score), pairs of different vectors found near.

    Pairs found twice count once; a query's own id is left out; ties go to the smaller id.
    """
    near = found.groupBy("_qgid", "_gid").agg(F.max("_score").alias("_score")).join(data.least, "_gid")
    order = Window.partitionBy("_qgid").orderBy(F.desc("_score"), "_vec")
    best = (near.select("_qgid", "_score", F.explode("_ids").alias("_vec")).withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= k + 1).select("_qgid", "_score", "_vec"))
    asked = data.members.filter(query).select(F.col("_id").alias("query_id"), F.col("_gid").alias("_qgid"), F.monotonically_increasing_id().alias("_row"))
    mine = Window.partitionBy("query_id", "_row").orderBy(F.desc("_score"), "_vec")
    return (asked.join(best, "_qgid").filter("_vec <> query_id").withColumn("rank", F.row_number().over(mine))
            .filter(F.col("rank") <= k).select("query_id", "rank", F.col("_vec").alias("vec_id"), F.col("_score").alias("score")))
