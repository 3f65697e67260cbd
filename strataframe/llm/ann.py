"""Approximate neighbours by balanced posting lists: boundary vectors in several lists, a graph over centroids,
lists chosen by distance ratio."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import written
from strataframe.llm.vectors import Distinct, answers, distinct_vectors, unpack

_FOUND = "_qgid long, _gid long, _score double"


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large and very small components neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(points: np.ndarray, leaves: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of about `leaves` clusters of equal size: each is cut in two halves again and again."""
    rng = np.random.default_rng(7)
    groups = [points]
    while len(groups) < leaves and max(len(g) for g in groups) > 1:
        cut = []
        for g in groups:
            if len(g) < 2:
                cut.append(g)
                continue
            pair = g[rng.choice(len(g), 2, replace=False)]
            for _ in range(rounds):
                # Halves of equal size: the median of the difference, not its sign, divides them.
                order = np.argsort(g @ (pair[0] - pair[1]), kind="stable")
                halves = g[order[len(g) // 2:]], g[order[:len(g) // 2]]
                pair = np.stack([h.mean(axis=0) for h in halves])
            cut += halves
        groups = cut
    means = np.stack([g.mean(axis=0) for g in groups])
    return means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)


class CentroidGraph:
    """Each centroid knows its nearest ones and a few far ones; a search walks from the entries to the nearest."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, far: int = 8):
        n = len(centroids)
        self.centroids = centroids.astype(np.float32)
        rng = np.random.default_rng(7)
        near = np.empty((n, min(degree, n - 1)), np.int64)
        for i in range(0, n, 1024):
            close = self.centroids[i:i + 1024] @ self.centroids.T
            close[np.arange(len(close)), np.arange(i, i + len(close))] = -np.inf
            near[i:i + 1024] = np.argsort(-close, axis=1, kind="stable")[:, :near.shape[1]]
        self.links = np.concatenate([near, rng.integers(0, n, (n, min(far, n - 1)))], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, x: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), nearest first, of each row of x; `width` is the search's memory."""
        x = x.astype(np.float32)
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        width = min(width, n)
        seen = np.zeros((len(x), n), bool)
        pool = np.broadcast_to(self.entries, (len(x), len(self.entries))).copy()
        seen[rows, pool] = True
        far = 2 - 2 * np.einsum("ij,ikj->ik", x, self.centroids[pool])
        walked = np.zeros(pool.shape, bool)
        while True:
            ahead = np.where(walked, np.inf, far)
            pick = np.argpartition(ahead, min(step, ahead.shape[1]) - 1, axis=1)[:, :step]
            if np.isinf(ahead[rows, pick]).all():
                break
            fresh = np.isfinite(ahead[rows, pick])
            walked[rows, pick] = True
            new = np.where(fresh[:, :, None], self.links[pool[rows, pick]], self.entries[0]).reshape(len(x), -1)
            new.sort(axis=1)
            known = seen[rows, new]
            known[:, 1:] |= new[:, 1:] == new[:, :-1]
            seen[rows, new] = True
            away = np.where(known, np.inf, 2 - 2 * np.einsum("ij,ikj->ik", x, self.centroids[new]))
            pool, far = np.concatenate([pool, new], axis=1), np.concatenate([far, away], axis=1)
            walked = np.concatenate([walked, known], axis=1)
            if pool.shape[1] > width:
                keep = np.argpartition(far, width - 1, axis=1)[:, :width]
                pool, far, walked = pool[rows, keep], far[rows, keep], walked[rows, keep]
        order = np.argsort(far, axis=1, kind="stable")
        return pool[rows, order], np.maximum(far[rows, order], 0)

    def within(self, x: np.ndarray, ratio: float, width: int = 32, together: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(rows, centroids): all centroids reached within `ratio` times the distance of each row's nearest one.

        The search finds the nearest; from there the walk goes on, however wide, through every
        centroid inside the bound until none is left whose links were not followed.
        """
        n, found = len(self.centroids), []
        for at in range(0, len(x), together):
            part = x[at:at + together].astype(np.float32)
            pool, away = self.search(part, width)
            far = np.full((len(part), n), np.inf, np.float32)
            np.put_along_axis(far, pool, away.astype(np.float32), axis=1)
            walked = np.zeros(far.shape, bool)
            while True:
                inside = far <= np.float32(ratio) ** 2 * far.min(axis=1, keepdims=True)
                inside[np.arange(len(part)), far.argmin(axis=1)] = True
                rows, here = np.nonzero(inside & ~walked)
                if not len(rows):
                    break
                walked[rows, here] = True
                new = np.unique(rows[:, None] * n + self.links[here])
                new = new[np.isinf(far.ravel()[new])]
                for i in range(0, len(new), 65_536):
                    r, c = np.divmod(new[i:i + 65_536], n)
                    far[r, c] = np.maximum(2 - 2 * np.einsum("ij,ij->i", part[r], self.centroids[c]), 0)
            rows, here = np.nonzero(inside)
            found.append((rows + at, here))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def homes(self, x: np.ndarray, ratio: float, most: int, width: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, whether each is a home) of each row: its nearest one and up to `most` within the ratio."""
        lists, far = self.search(x, width)
        inside = np.sqrt(far) <= ratio * np.sqrt(far[:, :1])
        inside[:, 0] = True
        inside[:, most:] = False
        return lists, inside


def _listed(batches: Iterator[pa.RecordBatch], graph, ratio: float, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """(_list, _gid, _x): a row for each list of a vector; up to `most` homes or, without it, all lists within the ratio."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            x = unit(unpack(part.column("_x"), "<f8"))
            if most:
                lists, inside = graph.value.homes(x, ratio, most)
                rows, places = np.nonzero(inside)
                chosen = lists[rows, places]
            else:
                rows, chosen = graph.value.within(x, ratio)
            # A query may have many lists, so its vector is repeated in pieces.
            for i in range(0, len(rows), 8192):
                index = pa.array(rows[i:i + 8192], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen[i:i + 8192], pa.int64()), part.column("_gid").take(index), part.column("_x").take(index)],
                    names=["_list", "_gid", "_x"])


def measured_reach(graph: CentroidGraph, points: np.ndarray, k: int, ratio: float, most: int, recall: float, asked: int = 512) -> float:
    """The ratio that reaches `recall` of the true neighbours, by brute force for `asked` of the sampled vectors.

    In the whole table neighbours are nearer than in a sample of it, so there it reaches no fewer.
    """
    asked, k = min(asked, len(points)), min(k, len(points) - 1)
    if k < 1:
        return 1.0
    needed = []
    for at in range(0, asked, 64):
        here = points[at:min(at + 64, asked)]
        score = here @ points.T
        score[np.arange(len(here)), np.arange(at, at + len(here))] = -np.inf
        best = np.argpartition(-score, k - 1, axis=1)[:, :k].ravel()
        away = np.sqrt(np.maximum(2 - 2 * (here.astype(np.float32) @ graph.centroids.T), 0))
        lists, inside = graph.homes(points[best], ratio, most)
        row = np.repeat(np.arange(len(here)), k)
        needed.append(np.where(inside, away[row[:, None], lists], np.inf).min(axis=1) / np.maximum(away.min(axis=1), 1e-6)[row])
    return max(1.0, float(np.quantile(np.concatenate(needed), recall, method="higher")))


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, each sum in the same order.

    Very large and very small components are scaled first, so that squares neither overflow nor vanish.
    """
    largest = np.abs(rows).max(axis=1), np.abs(queries).max(axis=1)
    odd = np.any([(m >= 1e100) | (m <= 1e-100) for m in largest], axis=0)
    if odd.any():
        queries, rows = queries.copy(), rows.copy()
        queries[odd] /= largest[1][odd, None]
        rows[odd] /= largest[0][odd, None]
    return (rows * queries).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((queries * queries).sum(axis=1)))


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best rows of one block of a list for each query that chose the list."""
    order = np.argsort(right["_gid"].to_numpy())
    names, docs = right["_gid"].to_numpy()[order], unpack(right["_x"], "<f8")
    out = []
    if len(names) and left.num_rows:
        docs = docs[order]
        scaled, asked, queries = unit(docs), unpack(left["_qx"], "<f8"), left["_qgid"].to_numpy()
        k = min(k, len(docs))
        for at in range(0, len(asked), 256):
            quick = unit(asked[at:at + 256]) @ scaled.T
            least = -np.partition(-quick, k - 1, axis=1)[:, k - 1:k]
            # The product of matrices rounds by position; what is near the border is measured anew.
            rows, best = np.nonzero(quick >= least - 1e-9)
            for i in range(0, len(rows), 65_536):
                r, b = rows[i:i + 65_536], best[i:i + 65_536]
                out.append((at + r, b, cosines(asked[at + r], docs[b])))
    if not out:
        return pa.table({"_qgid": pa.array([], pa.int64()), "_gid": pa.array([], pa.int64()), "_score": pa.array([], pa.float64())})
    rows, best, score = (np.concatenate(c) for c in zip(*out))
    by = np.lexsort((best, -score, rows))
    first = np.searchsorted(rows[by], rows[by], side="left")
    top = by[np.arange(len(by)) - first < k]
    return pa.table({"_qgid": pa.array(queries[rows[top]]), "_gid": pa.array(names[best[top]]), "_score": pa.array(score[top])})


@dataclass(frozen=True)
class Index:
    """`lists` (_list, _gid, _x): each vector in its homes. `asked` (_list, _gid, _x): each query in the lists it searches."""

    data: Distinct
    lists: DataFrame
    asked: DataFrame
    leaves: int
    reach: float


def posting_lists(df: DataFrame, queries: Column | str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                  sample_rows: int = 131_072, list_rows: int = 128, max_lists: int = 16_384, copies: int = 4,
                  boundary: float = 1.1, recall: float = 0.93) -> Index:
    """The lists of all vectors, and those that each query chooses; parameters as in `approximate_neighbours`."""
    spark = df.sparkSession
    data = distinct_vectors(df, id_col, vector_col, k + 1)
    n = data.vectors.count()
    sample = data.vectors.orderBy(F.xxhash64("_gid"), "_gid").limit(sample_rows).select("_x").toArrow()
    points = unit(unpack(sample["_x"], "<f8")) if n else np.ones((1, 1))
    leaves = max(1, min(max_lists, ceil(n / list_rows), len(points) // 4))
    centroids = CentroidGraph(balanced_centroids(points, leaves))
    reach = measured_reach(centroids, points, k, boundary, copies, recall)
    graph = spark.sparkContext.broadcast(centroids)
    shape = "_list long, _gid long, _x binary"
    lists = written(data.vectors.mapInArrow(partial(_listed, graph=graph, ratio=boundary, most=copies), shape), "lists")
    chosen = data.members.filter(queries).select("_gid").distinct().join(data.vectors, "_gid")
    asked = written(chosen.mapInArrow(partial(_listed, graph=graph, ratio=reach), shape), "asked")
    return Index(data, lists, asked, len(centroids.centroids), reach)


def approximate_neighbours(df: DataFrame, queries: Column | str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                           block_rows: int = 16_384, **index) -> DataFrame:
    """(query_id, rank, vec_id, score): near rows of each query row by cosine, nearest first.

    Centroids come from `sample_rows` vectors, those with the smallest hashed ids; one for each
    `list_rows` vectors, `max_lists` at most. A vector goes to the list of its nearest centroid and,
    near a boundary, to up to `copies` lists whose centroids are within `boundary` times that
    distance. A query walks the graph of centroids and searches every list within a ratio of its
    nearest centroid's distance, however many those are; brute force over the sample sets the ratio
    so that `recall` of the sample's own neighbours lie within it. Lists, and the queries of a list,
    are cut into blocks of `block_rows`; a block of each is a task's work.

    `queries` is a condition on `_id`. Vectors that are null, zero, of odd length, or hold null or
    non-finite components take no part. Ties go to the smaller id; rows that share the query's id
    count as its own; repeated rows ask each; equal vectors are indexed and searched once.
    """
    made = posting_lists(df, queries, k, id_col, vector_col, **index)
    rows = made.lists
    asked = made.asked.select("_list", F.col("_gid").alias("_qgid"), F.col("_x").alias("_qx"))
    # One row a centroid, at most `max_lists` twice over.
    size = F.ceil(F.count("*") / block_rows).cast("int")
    sizes = F.broadcast(rows.groupBy("_list").agg(size.alias("_rows")).join(asked.groupBy("_list").agg(size.alias("_asked")), "_list"))
    rows, asked = rows.join(sizes, "_list"), asked.join(sizes, "_list")
    rows = (rows.withColumn("_b", F.pmod(F.xxhash64("_gid"), "_rows").cast("int"))
            .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_asked") - 1))).drop("_rows", "_asked"))
    asked = (asked.withColumn("_q", F.pmod(F.xxhash64("_qgid"), "_asked").cast("int"))
             .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).drop("_rows", "_asked"))
    block = ["_list", "_b", "_q"]
    found = asked.groupBy(*block).cogroup(rows.groupBy(*block)).applyInArrow(lambda key, left, right: _search(left, right, k + 1), _FOUND)
    return answers(found, made.data, queries, k)
