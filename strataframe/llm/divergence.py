"""How the sources of a language differ: hash-consed segment trees over term ids, traversed in pairs.

The terms of a language are dealt into blocks, and a block's terms get ids in the order of how common
they are, so that like counts lie side by side. Each group of a language is a segment tree over a
block: its leaves are counts, its inner nodes pairs of nodes, and equal subtrees, of one group or of
several, are one node. Two trees are walked together from their roots; a pair of nodes met before is
not walked again, and every pair of counts is priced once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import ship, written

# The smoothing and the scale of the shares.
PRIOR, SCALE = 5, 1_000_000_000
_TERMS = re.compile(rb"[a-z\x80-\xff]+")
_HELD = 400_000
_WALKED = 1 << 21
_COUNTS = pa.schema([("_lang", pa.string()), ("_source", pa.string()), ("_term", pa.string()), ("_n", pa.int64()), ("_docs", pa.int64())])


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII, as they are."""
    return _TERMS.findall(text.encode().lower())


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms, added up as far as memory is meant to go."""
    counts, docs, size = defaultdict(Counter), defaultdict(Counter), 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            names = list(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array([t.decode() for t in names], pa.string()),
                 pa.array(own.values(), pa.int64()), pa.array([docs[lang, source][t] for t in names], pa.int64())], schema=_COUNTS)

    for batch in batches:
        for lang, source, text in zip(batch.column("_lang").to_pylist(), batch.column("_source").to_pylist(), batch.column("_text")):
            found = Counter(terms(text.as_py()))
            own = counts[lang, source]
            size -= len(own)
            own.update(found)
            size += len(own)
            docs[lang, source].update(found.keys())
            if size > _HELD:
                yield from flush()
                counts, docs, size = defaultdict(Counter), defaultdict(Counter), 0
    yield from flush()


def shares(counts: np.ndarray, below: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / below), exactly."""
    if counts.max(initial=0) < (1 << 62) // SCALE and below < 1 << 62:
        return 1 + SCALE * (counts + PRIOR) // below
    return np.array([1 + SCALE * (c + PRIOR) // below for c in counts.tolist()], np.int64)


class Forest:
    """Segment trees over equally long count rows; equal subtrees are one node."""

    def __init__(self, counts: np.ndarray):
        """`counts`: a row a group. Rows are filled with zeros up to a power of two."""
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        full = np.zeros((counts.shape[0], width), np.int64)
        full[:, :counts.shape[1]] = counts
        self.leaf_counts, nodes = np.unique(full, return_inverse=True)
        nodes = nodes.reshape(full.shape)
        #: By height from the leaves' parents to the roots: the two children of each node.
        self.children: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            pairs = nodes[:, ::2] << 32 | nodes[:, 1::2]
            known, nodes = np.unique(pairs, return_inverse=True)
            nodes = nodes.reshape(pairs.shape)
            self.children.append(np.stack([known >> 32, known & 0xFFFFFFFF], axis=1))
        self.roots = nodes[:, 0]

    def walk(self, left: np.ndarray, right: np.ndarray, price) -> np.ndarray:
        """Sums over all leaves of price(pair, count of the left tree, count of the right tree).

        `left` and `right` are groups, pair by pair; `price` takes arrays. All pairs are walked side by
        side, level by level; the nodes that a pair of trees meets twice are walked and priced once.
        """
        pair, a, b = np.arange(len(left)), self.roots[left], self.roots[right]
        met = []
        for height in range(len(self.children) - 1, -1, -1):
            children = self.children[height]
            nodes = len(self.children[height - 1]) if height else len(self.leaf_counts)
            if nodes * nodes * len(left) >= 1 << 63:
                raise ValueError("too many nodes for one walk: take smaller blocks")
            below = np.concatenate([(pair * nodes + children[a, i]) * nodes + children[b, i] for i in (0, 1)])
            below, place = np.unique(below, return_inverse=True)
            met.append(place.reshape(2, -1))
            pair, a, b = below // nodes // nodes, below // nodes % nodes, below % nodes
        value = price(pair, self.leaf_counts[a], self.leaf_counts[b])
        for place in reversed(met):
            value = value[place[0]] + value[place[1]]
        return value


def _pair_sums(forest: Forest, pairs: list[tuple[int, int]], below: list[int], terms_of_block: int) -> Iterator[tuple[int, int, int]]:
    """Sums of the differences of the pairs' shares, a few pairs side by side."""
    width = 1 << len(forest.children)
    together = max(1, _WALKED // width)
    for at in range(0, len(pairs), together):
        left, right = np.array(pairs[at:at + together]).T

        def price(pair: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.abs(_shares_of(left[pair], a, below) - _shares_of(right[pair], b, below))

        none = np.zeros(len(left), np.int64)
        # Zeros that only fill the trees up are no terms; terms that no tree here has are missing zeros.
        value = forest.walk(left, right, price) - (width - terms_of_block) * price(np.arange(len(left)), none, none)
        yield from zip(left.tolist(), right.tolist(), value.tolist())


def _best_terms(counts: np.ndarray, below: int, q: np.ndarray, best: int) -> list[tuple[int, int]]:
    """(term id, difference) of the terms of one group whose share is furthest above the language's."""
    seen = np.flatnonzero(counts)
    over = shares(counts[seen], below) - q[seen]
    seen, over = seen[over > 0], over[over > 0]
    if len(seen) > best:
        least = np.partition(over, len(over) - best)[len(over) - best]
        seen, over = seen[over >= least], over[over >= least]
    return list(zip(seen.tolist(), over.tolist()))


def _shares_of(group: np.ndarray, count: np.ndarray, below: list[int]) -> np.ndarray:
    out = np.empty(len(count), np.int64)
    for g in np.unique(group).tolist():
        own = group == g
        out[own] = shares(count[own], below[g])
    return out


def _compared(key, rows: pa.Table, groups: pa.Table, best: int) -> pa.Table:
    """One block of a language's terms for two tiles of its sources, or one tile with itself."""
    lang, _, first, second = (k.as_py() for k in key)
    group = sorted(zip(groups["_tile"].to_pylist(), groups["_source"].to_pylist(), groups["_below"].to_pylist()))
    sources, below = [g[1] for g in group], [g[2] for g in group]
    cut = sum(g[0] == first for g in group)
    pairs = [(i, j) for i in range(cut) for j in range(i + 1 if first == second else cut, len(group))]
    terms_of = rows["_term"].to_pylist()
    total = dict(zip(terms_of, rows["_total"].to_pylist()))
    # Ids go by how common a term is in its language.
    names = sorted(total, key=lambda t: (-total[t], t))
    place, number = {t: k for k, t in enumerate(names)}, {s: k for k, s in enumerate(sources)}
    counts = np.zeros((len(sources), max(1, len(names))), np.int64)
    counts[[number[s] for s in rows["_source"].to_pylist()], [place[t] for t in terms_of]] = rows["_n"].to_numpy()
    lang_below, out = groups["_lang_below"][0].as_py(), []
    # Where the language keeps no term, every pair is worth nothing.
    for i, j, value in _pair_sums(Forest(counts), pairs, below, groups["_terms"][0].as_py() or 0) if lang_below else ((i, j, 0) for i, j in pairs):
        out += [(sources[i], "pair", sources[j], value), (sources[j], "pair", sources[i], value)]
    if first == second and names:
        q = shares(np.array([total[t] for t in names]), lang_below)
        for i in range(len(group)):
            found = [(-value, names[k].encode(), names[k]) for k, value in _best_terms(counts[i], below[i], q, best)]
            out += [(sources[i], "term", name, -value) for value, _, name in sorted(found)[:best]]
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), **{n: pa.array(c, pa.string()) for n, c in zip(("source", "part", "item"), columns)},
                     "value": pa.array(columns[3], pa.int64())})


def source_divergence(df: DataFrame, min_docs: int = 30, best_terms: int = 50, lang_col: str = "lang", source_col: str = "source",
                      text_col: str = "text", block_terms: int = 16_384, tile_sources: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source's shares of terms are from its language's others.

    A language keeps the terms that `min_docs` of its rows hold; a share is 1 + floor(10^9 * (count + 5) /
    (N + 5 * V)), N the count of all kept terms and V their number. Part `pair` sums the differences of
    two sources over all kept terms; part `term` lists the terms, `best_terms` at most, whose share is
    above the language's. Ranks go by value, ties by the item's UTF-8 bytes.

    Null texts, languages and sources are empty ones. Every group that occurs has its pairs, also
    without a term, with value 0 where the language keeps none; a lone source has none. Repeated rows
    count again; texts of any length count whole; an empty table gives no rows; other columns play no
    part. A task holds one block of a language's terms for two tiles of its sources.
    """
    ship(df.sparkSession)

    def text(name: str, alias: str):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(alias)

    docs = df.select(text(lang_col, "_lang"), text(source_col, "_source"), text(text_col, "_text"))
    counted = docs.mapInArrow(_term_counts, "_lang string, _source string, _term string, _n long, _docs long")
    counted = written(counted.groupBy("_lang", "_source", "_term").agg(F.sum("_n").alias("_n"), F.sum("_docs").alias("_docs")), "term_counts")
    same = Window.partitionBy("_lang", "_term")
    kept = written(counted.select("*", F.sum("_n").over(same).alias("_total"), F.sum("_docs").over(same).alias("_all_docs"))
                   .filter(F.col("_all_docs") >= min_docs).select("_lang", "_source", "_term", "_n", "_total"), "kept_terms")
    langs = (kept.select("_lang", "_term", "_total").distinct().groupBy("_lang").agg(F.count("*").alias("_v"), F.sum("_total").alias("_lang_n")))
    sizes = kept.groupBy("_lang", "_source").agg(F.sum("_n").alias("_own_n"))
    zero = F.lit(0).cast("long")
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_source"))
    groups = (docs.select("_lang", "_source").distinct().join(langs, "_lang", "left").join(sizes, ["_lang", "_source"], "left")
              .select("_lang", "_source", F.coalesce("_v", zero).alias("_v"),
                      (F.coalesce("_own_n", zero) + PRIOR * F.coalesce("_v", zero)).alias("_below"),
                      (F.coalesce("_lang_n", zero) + PRIOR * F.coalesce("_v", zero)).alias("_lang_below"),
                      F.floor((place - 1) / tile_sources).cast("long").alias("_tile")))
    groups = groups.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_v") / block_terms)).cast("long"))
    groups = written(groups.withColumn("_tiles", F.max("_tile").over(Window.partitionBy("_lang"))), "groups")
    # Each tile meets itself and every other one once.
    other = F.explode(F.sequence(zero, F.col("_tiles"))).alias("_other")

    def meet(frame: DataFrame) -> DataFrame:
        return (frame.select("*", other).withColumn("_first", F.least("_tile", "_other")).withColumn("_second", F.greatest("_tile", "_other")))

    rows = kept.join(groups, ["_lang", "_source"]).withColumn("_block", F.pmod(F.xxhash64("_lang", "_term"), F.col("_blocks")))
    # Terms that no source of two tiles has count too: both shares of nothing may differ.
    sizes = rows.select("_lang", "_block", "_term").distinct().groupBy("_lang", "_block").agg(F.count("*").alias("_terms"))
    asked = meet(groups.select("*", F.explode(F.sequence(zero, F.col("_blocks") - 1)).alias("_block")).join(sizes, ["_lang", "_block"], "left"))
    rows = meet(rows)
    keys = ["_lang", "_block", "_first", "_second"]
    parts = (rows.select(*keys, "_source", "_term", "_n", "_total").groupBy(*keys)
             .cogroup(asked.select(*keys, "_source", "_tile", "_below", "_lang_below", "_terms").groupBy(*keys))
             .applyInArrow(partial(_compared, best=best_terms), "lang string, source string, part string, item string, value long"))
    total = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return total.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= best_terms)).select(
        "lang", "source", "part", "item", "value", "rank")
