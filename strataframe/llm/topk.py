"""Exact top-k by inner product: postings scattered term by term into score arrays, block by block."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.vectors import answers, distinct_vectors, unpack

_FOUND = "_qgid long, _gid long, _score long"


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the smaller place, by partition and not by sorting all."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = scores[np.argpartition(-scores, k - 1)[:k]].min()
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """All queries of one block against all vectors of another."""
    order = np.argsort(right["_gid"].to_numpy())
    names, docs = right["_gid"].to_numpy()[order], unpack(right["_x"], "<i8")
    docs = docs[order]
    asked = unpack(left["_qx"], "<i8") if len(names) and left.num_rows else None
    if asked is not None and int(np.abs(asked).max()) * int(np.abs(docs).max()) * docs.shape[1] >= 1 << 63:
        raise ValueError("inner products may not fit 64 bits: take a smaller scale")
    postings = []
    for term in range(docs.shape[1]):
        rows = np.flatnonzero(docs[:, term])
        # A term that every vector has needs no list of places.
        postings.append((slice(None) if len(rows) == len(docs) else rows, docs[rows, term]))
    out = []
    for name, query in zip(left["_qgid"].to_pylist(), asked if asked is not None else []):
        scores = np.zeros(len(docs), np.int64)
        for term in np.flatnonzero(query):
            rows, weights = postings[term]
            scores[rows] += query[term] * weights
        best = best_rows(scores, k)
        out.append((np.full(len(best), name), names[best], scores[best]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("_qgid", "_gid", "_score"), columns)})


def exact_top_k(df: DataFrame, queries: Column | str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
                block_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k largest integer inner products with other rows.

    Components become floor(scale * x). `queries` is a condition on `_id`. Vectors that are null, of
    odd length, or hold null or non-finite components take no part; zero vectors do. Ties go to the
    smaller id; rows that share the query's id count as its own; repeated rows ask each; fewer
    candidates give fewer rows. Equal vectors are searched once.

    Vectors and queries are dealt into blocks by hash, every query block meets every vector block in
    one task, and each returns k + 1 rows a query, which are merged. An empty table gives no rows. A
    block whose largest components could make a product of over 64 bits stops the job.
    """
    data = distinct_vectors(df, id_col, vector_col, k + 1, "<i8", scale, nonzero=False)
    asked = data.members.filter(queries).select("_gid").distinct().join(data.vectors, "_gid")
    blocks = max(1, ceil(data.vectors.count() / block_rows))
    query_blocks = max(1, ceil(asked.count() / query_rows))
    own = (data.vectors.withColumn("_b", F.pmod(F.xxhash64("_gid", F.lit(1)), F.lit(blocks)))
           .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>"))))
    asked = (asked.select(F.col("_gid").alias("_qgid"), F.col("_x").alias("_qx")).withColumn("_q", F.pmod(F.xxhash64("_qgid", F.lit(1)), F.lit(query_blocks)))
             .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))))
    found = asked.groupBy("_b", "_q").cogroup(own.groupBy("_b", "_q")).applyInArrow(
        lambda key, left, right: _search(left, right, k + 1), _FOUND)
    return answers(found, data, queries, k)
