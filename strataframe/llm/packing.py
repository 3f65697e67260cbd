"""Packing by lexical retrieval: a sharded BM25 index hands each seed its unused neighbours, which fill its window."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import slices, texts, written
from strataframe.llm.tokens import load

K1, B = 1.2, 0.75
# A term that one in so many documents of a shard has is a row of its matrix.
_DENSE = 8
# Projected directions, groups of alike texts at most, and sampled texts for each of them.
_DIRECTIONS, _CENTRES, _SAMPLE = 48, 128, 32
_PIECES = pa.schema([("_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES = "_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_WAITING = pa.schema([*_PIECES, ("near", pa.int64()), ("rare", pa.int64()), ("place", pa.int64()), ("occurs", pa.binary())])


def _tokenised(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int, groups) -> Iterator[pa.RecordBatch]:
    """Whole windows of a document become sequences at once; its rest, if any, waits with its ids.

    The last row holds, as bytes, in how many rests each id occurs.
    """
    bpe, sequence = load(tokenizer), TaskContext.get().partitionId() << 32
    place = sequence
    occurs = np.zeros(max(bpe.vocabulary, end_id + 1), np.int64)
    for batch in slices(batches, 512):
        rows = []
        for doc, made in zip(batch.column("_id").to_pylist(), bpe.encode_many(t.as_py() for t in batch.column("_text"))):
            ids = np.append(made, np.uint32(end_id)).astype("<u4", copy=False)
            full = len(ids) // window * window
            for start in range(0, full, window):
                rows.append((doc, start, window, len(ids), 2 * sequence, 0, ids[start:start + window].tobytes(), 0, 0, 0, None))
                sequence += 1
            if full < len(ids):
                terms, counts = np.unique(ids[full:], return_counts=True)
                occurs[terms] += 1
                rows.append((doc, full, len(ids) - full, len(ids), None, None, ids[full:].tobytes(), *groups.value.of(terms, counts), place, None))
                place += 1
        columns = list(zip(*rows)) if rows else [[]] * len(_WAITING)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WAITING)], schema=_WAITING)
    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(_WAITING)[:-1]], pa.array([occurs.tobytes()], pa.binary())], schema=_WAITING)


def bm25(counts: np.ndarray, length, mean: float) -> np.ndarray:
    """How much a term's occurrences in a text of some length weigh, before its idf."""
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / mean))


@lru_cache(maxsize=2)
def _signs(vocabulary: int) -> np.ndarray:
    """A fixed row of signs for each id: sums of them keep the angles between weighted texts."""
    return np.random.default_rng(17).choice(np.array([-1, 1], np.float32), (vocabulary, _DIRECTIONS))


class Groups:
    """Groups of alike texts, from a sample: centres of BM25 weights, projected to a few directions."""

    def __init__(self, sample: list[np.ndarray], vocabulary: int, k: int):
        counts = np.zeros(vocabulary)
        for ids in sample:
            counts[np.unique(ids)] += 1
        self.idf = np.log(1 + (len(sample) - counts + 0.5) / (counts + 0.5))
        #: Ids that fewer than two texts of the sample hold may belong to one text alone.
        self.shared = np.where(counts > 1, self.idf, -1.0)
        self.mean = float(np.mean([len(x) for x in sample])) if sample else 1.0
        points = np.array([self.direction(*np.unique(x, return_counts=True), len(x)) for x in sample], np.float32).reshape(-1, _DIRECTIONS)
        self.centres = self._centres(np.unique(points, axis=0), k)

    def direction(self, terms: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
        x = (self.idf[terms] * bm25(counts, length, self.mean)).astype(np.float32) @ _signs(len(self.idf))[terms]
        return x / max(float(np.sqrt(x.dot(x))), 1e-9)

    @staticmethod
    def _centres(points: np.ndarray, k: int) -> np.ndarray:
        if not len(points):
            return np.zeros((1, _DIRECTIONS), np.float32)
        found = points[np.random.default_rng(17).choice(len(points), min(k, len(points)), replace=False)]
        for _ in range(10):
            sums = np.zeros_like(found)
            np.add.at(sums, (points @ found.T).argmax(axis=1), points)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            found = np.where(size > 0, sums / np.maximum(size, 1e-9), found)
        return found

    def of(self, terms: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
        """A text's group, and its two rarest ids that others have too, from its distinct ids and their counts."""
        near = int((self.centres @ self.direction(terms, counts, int(counts.sum()))).argmax())
        rarity = self.shared[terms]
        first = int(rarity.argmax())
        rarity[first] = -2.0
        return near, int(terms[first]) << 32 | int(terms[rarity.argmax()])


def _sampled(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    bpe = load(tokenizer)
    for batch in slices(batches, 512):
        ids = [np.append(made, np.uint32(end_id)).astype("<u4", copy=False) for made in bpe.encode_many(t.as_py() for t in batch.column("_text"))]
        yield pa.RecordBatch.from_arrays([pa.array([x[len(x) // window * window:].tobytes() for x in ids], pa.binary())], names=["ids"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for occurs in batch.column("occurs"):
            own = np.frombuffer(occurs.as_py(), np.int64)
            counts = own + counts if len(counts) else own
    terms = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts[terms], pa.int64())], names=["term", "n"])


class Shard:
    """An inverted BM25 index over the token ids of some documents, and the windows filled from it."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.ids = ids
        lengths = np.array([len(x) for x in ids])
        keys, counts = np.unique(np.repeat(np.arange(len(ids), dtype=np.int64), lengths) << 32 | np.concatenate(ids).astype(np.int64),
                                 return_counts=True)
        docs, terms = keys >> 32, keys & 0xFFFFFFFF
        weights = idf[terms] * bm25(counts, lengths[docs], mean)
        # A document's own terms are its query, all of them.
        self.doc_starts = np.searchsorted(docs, np.arange(len(ids) + 1))
        self.doc_terms = terms
        # Sixteen bits sort by counting.
        by = np.argsort(terms.astype(np.uint16) if terms.max() < 1 << 16 else terms, kind="stable")
        self.post_docs, self.post_weights = docs[by], weights[by]
        self.terms, starts = np.unique(terms[by], return_index=True)
        self.post_starts = np.append(starts, len(by))
        # Long postings are rows of a matrix, at most as many as their entries pay for.
        sizes = np.diff(self.post_starts)
        common = np.flatnonzero(sizes * _DENSE >= len(ids))
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(ids)))
        long = np.repeat(self.row, sizes)
        self.dense[long[long >= 0], self.post_docs[long >= 0]] = self.post_weights[long >= 0]
        self.held = np.arange(len(ids))
        # Rows of a query are copied to one place; fresh memory would cost more than the copy.
        self.copied = np.empty(0)

    def forget(self, used: np.ndarray) -> None:
        """Used documents need no more scores; once they are half of the matrix, it shrinks."""
        keep = ~used[self.held]
        if 2 * np.count_nonzero(keep) <= len(keep):
            self.dense, self.held = np.ascontiguousarray(self.dense[:, keep]), self.held[keep]

    def scores(self, seed: int) -> np.ndarray:
        a, b = self.doc_starts[seed], self.doc_starts[seed + 1]
        at = np.searchsorted(self.terms, self.doc_terms[a:b])
        row = self.row[at]
        dense, rare = row[row >= 0], at[row < 0]
        size = len(dense) * len(self.held)
        if size > len(self.copied):
            self.copied = np.empty(size)
        copied = self.copied[:size].reshape(len(dense), len(self.held))
        score = np.zeros(len(self.ids))
        score[self.held] = self.dense.take(dense, axis=0, out=copied, mode="clip").sum(axis=0)
        if len(rare):
            starts = self.post_starts[rare]
            sizes = self.post_starts[rare + 1] - starts
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
            score += np.bincount(self.post_docs[place], self.post_weights[place], minlength=len(self.ids))
        return score

    def windows(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, first id, length). All but the last are full: what does not fit is cut."""
        left = np.array([len(x) for x in self.ids])
        begun = np.zeros(len(self.ids), np.int64)
        next_unused = 0
        while True:
            while next_unused < len(left) and not left[next_unused]:
                next_unused += 1
            if next_unused == len(left):
                return
            seed, room, pieces = next_unused, window, []

            def take(doc: int, size: int) -> None:
                nonlocal room
                pieces.append((doc, int(begun[doc]), size))
                begun[doc] += size
                left[doc] -= size
                room -= size

            take(seed, min(room, int(left[seed])))
            if room and left.any():
                self.forget(left == 0)
                score = np.where(left > 0, self.scores(seed), 0)
                # What did not fit before does not fit any more, so the best that fits is the next in order.
                while room:
                    best = int(np.where(left <= room, score, 0).argmax())
                    if left[best] > room or not score[best]:
                        break
                    take(best, int(left[best]))
                    score[best] = 0
                # The best neighbour that is left is cut to fit, then any unused document.
                best = int(score.argmax())
                for doc in chain((best,) if score[best] else (), range(next_unused, len(left))):
                    if not room:
                        break
                    if left[doc]:
                        take(doc, min(room, int(left[doc])))
            yield pieces


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cuts a window that is not full into sequences whose lengths are powers of two, so none is padded."""
    queue = list(reversed(pieces))
    total = sum(p[2] for p in pieces)
    for bit in reversed(range(total.bit_length())):
        room, out = (1 << bit) & total, []
        while room:
            doc, start, size = queue.pop()
            used = min(room, size)
            out.append((doc, start, used))
            room -= used
            if used < size:
                queue.append((doc, start + used, size - used))
        if out:
            yield out


def _packed(batches: Iterator[pa.RecordBatch], statistics, window: int, shard_docs: int) -> Iterator[pa.RecordBatch]:
    idf, mean = statistics.value
    sequence = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        nonlocal sequence
        ids = [np.frombuffer(r[3], "<u4") for r in held]
        rows = []
        shard = Shard(ids, idf, mean)
        for pieces in shard.windows(window):
            full = sum(p[2] for p in pieces) == window
            for part in [pieces] if full else powers(pieces):
                offset = 0
                for doc, start, size in part:
                    name, first, doc_tokens, _ = held[doc]
                    rows.append((name, first + start, size, doc_tokens, 2 * sequence + 1, offset, ids[doc][start:start + size].tobytes()))
                    offset += size
                sequence += 1
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("_id", "start", "doc_tokens", "ids")]):
            held.append(row)
            if len(held) == shard_docs:
                yield flush()
                held = []
    if held:
        yield flush()


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
                   shard_docs: int = 2048) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, ids) of every piece of every document.

    A document's whole windows are sequences of their own. The rests are dealt into shards of at most
    `shard_docs`, ranged by the group of alike texts they belong to (centres fitted on a sample of 32
    texts for each of at most 128) and their two rarest shared ids. In a shard each unused document
    seeds a window; BM25 over token ids, with document counts of the whole table, ranks its unused
    neighbours by all the seed's ids, and all that share one are taken in that order. They fill the window while they fit whole,
    then one is cut. The last window of a shard is cut into powers of two, so nothing is padded.

    Null and empty texts are the end id alone; ids are integers or null; repeated rows are packed one
    by one; an empty table gives no rows. Terms are bounded by the vocabulary, shards by their size.
    """
    rows = texts(df, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    n = rows.count()
    k = min(_CENTRES, 2 * ceil(max(1, n) / shard_docs))
    picked = rows.select("_text").sample(min(1.0, _SAMPLE * k / max(1, n)), seed=17)
    picked = picked.mapInArrow(partial(_sampled, tokenizer=tokenizer, end_id=end_id, window=window), "ids binary").toArrow()["ids"].to_pylist()
    groups = Groups([np.frombuffer(x, "<u4") for x in picked if x], max(load(tokenizer).vocabulary, end_id + 1), k)
    run = partial(_tokenised, tokenizer=tokenizer, end_id=end_id, window=window, groups=df.sparkSession.sparkContext.broadcast(groups))
    pieces = written(rows.mapInArrow(run, PIECES + ", near long, rare long, place long, occurs binary"), "pieces")
    whole = pieces.filter("sequence_id is not null").drop("near", "rare", "place", "occurs")
    rest = pieces.filter("sequence_id is null and occurs is null")
    terms = (pieces.filter("occurs is not null").select("occurs").mapInArrow(_document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    total = rest.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean")).first()
    counts = np.zeros(max(1, 1 + max(terms["term"].to_pylist(), default=0)))
    counts[terms["term"].to_numpy()] = terms["n"].to_numpy()
    idf = np.log(1 + (total["n"] - counts + 0.5) / (counts + 0.5))
    shared = df.sparkSession.sparkContext.broadcast((idf, total["mean"]))
    # Places differ even for repeated rows, and the ranges are found without reading ids.
    order = ["near", "rare", "place"]
    dealt = rest.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "start", "doc_tokens", "ids")
    run = partial(_packed, statistics=shared, window=window, shard_docs=shard_docs)
    return whole.unionByName(dealt.mapInArrow(run, PIECES)).withColumnRenamed("_id", id_col)
