"""Language-model scores by partial matching: a byte-context trie with escapes and symbol exclusion.

A text is its lower-cased words, a space before each and before the end, a symbol of its own. Each
byte is coded in the `order` bytes before it, across words or, if so chosen, back to the last space.
A byte and its context are a window, and the code length of each different window is worked out once.
Windows that share their two bytes before the symbol meet in one task with all their longer contexts;
shorter ones are known everywhere. So no edge is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import ceil, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import slices, texts, written

END = b"\n"
ALPHABET = 256
_HELD_WORDS = 250_000
_HELD_WINDOWS = 1_000_000
_DEPTH = 56


def tokens(text: str) -> list[bytes]:
    """Words of a text, ASCII letters in lower case, and one end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of every word, zero for words that only other documents have."""
    counts: Counter = Counter()
    names = ["_word", "_c"]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=names)

    for batch in batches:
        for text, train in zip(batch.column("_text"), batch.column("_train").to_pylist()):
            words = tokens(text.as_py())
            if train:
                counts.update(words)
            else:
                for w in set(words):
                    counts.setdefault(w, 0)
            if len(counts) > _HELD_WORDS:
                yield flush()
                counts = Counter()
    yield flush()


def contexts(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(owner, depth, keys by order) of every coded byte.

    `depth` is how many bytes of context it has; keys[d] holds the last d bytes before it and itself.
    """
    return stream_contexts([b" " + w + (b"" if w == END else b" ") for w in words], order)


def stream_contexts(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """As `contexts`, of streams whose first byte is not coded."""
    sizes = np.array([len(s) for s in streams])
    data = np.frombuffer(b"".join(streams), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(streams)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, key = [data], data
    for d in range(1, order + 1):
        key = key.copy()
        key[d:] += data[:-d] << (8 * d)
        keys.append(key)
    coded = place > 0
    return owner[coded], place[coded], [k[coded] for k in keys]


def windows(texts: list[str], order: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of every coded byte; a window is its depth, its context and the byte."""
    words = [tokens(t) for t in texts]
    if across:
        owner, depth, keys = stream_contexts([b" " + b" ".join(w) for w in words], order)
    else:
        owner, depth, keys = contexts([x for w in words for x in w], order)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])[owner]
    depth = np.minimum(depth, order)
    return owner, np.choose(depth, keys) | depth << _DEPTH


def _window_counts(batches: Iterator[pa.RecordBatch], order: int, across: bool) -> Iterator[pa.RecordBatch]:
    """Occurrences of every window in training texts and in all."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)

    def rows() -> pa.RecordBatch:
        keys, n = held[0]
        return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(n * (keys & 1)), pa.array(n)], names=["_w", "_c", "_all"])

    for batch in slices(batches, 256):
        owner, keys = windows(batch.column("_text").to_pylist(), order, across)
        train = np.array([bool(t) for t in batch.column("_train").to_pylist()])
        held.append(np.unique(keys << 1 | train[owner], return_counts=True))
        if sum(len(h[0]) for h in held) > 2 * _HELD_WINDOWS:
            held = [merged()]
            if len(held[0][0]) > _HELD_WINDOWS:
                yield rows()
                held = []
    if held:
        held = [merged()]
        yield rows()


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Trie:
    """Contexts and their symbols with counts, by order; an edge is a context and a symbol."""

    def __init__(self, order: int, d: np.ndarray, edges: np.ndarray, counts: np.ndarray):
        self.order = order
        self.edges, self.counts, self.nodes = [], [], []
        self.total, self.kinds, self.lower_total, self.lower_kinds = [], [], [], []
        for k in range(order + 1):
            own = d == k
            by = np.argsort(edges[own])
            e, c = edges[own][by], counts[own][by].astype(np.float64)
            nodes, node = np.unique(e >> 8, return_inverse=True)
            self.edges.append(e)
            self.counts.append(c)
            self.nodes.append(nodes)
            self.total.append(np.bincount(node, c, len(nodes)))
            self.kinds.append(np.bincount(node, minlength=len(nodes)).astype(np.float64))
            if k == 0:
                self.lower_total.append(np.zeros(len(nodes)))
                self.lower_kinds.append(np.zeros(len(nodes)))
                continue
            # What is left of the next shorter context once this one's symbols are excluded from it.
            at, _ = _find(self.edges[k - 1], e & ((1 << 8 * k) - 1))
            up, _ = _find(self.nodes[k - 1], nodes & ((1 << 8 * (k - 1)) - 1))
            self.lower_total.append(self.total[k - 1][up] - np.bincount(node, self.counts[k - 1][at], len(nodes)) if len(e) else np.zeros(0))
            self.lower_kinds.append(self.kinds[k - 1][up] - self.kinds[k] if len(e) else np.zeros(0))

    def log10_words(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability, its closing space included."""
        if not words:
            return np.zeros(0)
        owner, depth, keys = contexts(words, self.order)
        return np.bincount(owner, self.log10_places(depth, keys), len(words))

    def log10_places(self, depth: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each byte in its context, as `contexts` gives them."""
        result = np.zeros(len(depth))
        open_ = np.arange(len(depth))
        before = np.full(len(depth), -1)
        for k in range(self.order, -1, -1):
            rows = open_[depth[open_] >= k]
            key = keys[k][rows]
            node, known = _find(self.nodes[k], key >> 8)
            rows, key, node = rows[known], key[known], node[known]
            if not len(rows):
                continue
            total, kinds = self.total[k][node], self.kinds[k][node]
            longer = before[rows] >= 0
            if longer.any():
                total[longer] = self.lower_total[k + 1][before[rows[longer]]]
                kinds[longer] = self.lower_kinds[k + 1][before[rows[longer]]]
            edge, hit = _find(self.edges[k], key)
            share = np.where(hit, self.counts[k][edge] if len(self.edges[k]) else 0.0, kinds)
            # A context whose symbols are all excluded is left without a choice, at no cost.
            certain = ~hit & (kinds <= 0)
            result[rows] += np.where(certain, 0.0, np.log10(np.where(certain, 1.0, share) / np.where(certain, 1.0, total + kinds)))
            before[rows] = node
            done = np.zeros(len(depth), bool)
            done[rows[hit]] = True
            open_ = open_[~done[open_]]
        known_symbols = self.kinds[0][0] if len(self.kinds[0]) else 0.0
        result[open_] -= log10(max(1.0, ALPHABET - known_symbols))
        return result


def _scored_windows(rows: pa.Table, low, order: int) -> pa.Table:
    """Windows with all that share their last two context bytes; `low` has the edges of orders 0 and 1."""
    keys, count = rows["_w"].to_numpy(), rows["_c"].to_numpy()
    depth, parts = keys >> _DEPTH, [tuple(x[low.value[0] <= order] for x in low.value)]
    for d in range(2, order + 1):
        own = (depth >= d) & (count > 0)
        edges, at = np.unique(keys[own] & (1 << 8 * (d + 1)) - 1, return_inverse=True)
        parts.append((np.full(len(edges), d), edges, np.bincount(at, count[own], len(edges))))
    trie = Trie(order, *[np.concatenate(x) for x in zip(*parts)])
    score = trie.log10_places(depth, [keys & (1 << 8 * (d + 1)) - 1 for d in range(order + 1)])
    return pa.table({"_w": rows["_w"], "_all": rows["_all"], "_lp": pa.array(score, pa.float64())})


def _window_spread(batches: Iterator[pa.RecordBatch], frequent, order: int, across: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document's sum over frequent windows, and one for each of its other windows."""
    known, scores = frequent.value
    for batch in slices(batches, 256):
        rid = batch.column("_rid").to_numpy()
        owner, keys = windows(batch.column("_text").to_pylist(), order, across)
        distinct, at = np.unique(keys, return_inverse=True)
        place, hit = _find(known, distinct)
        score = np.where(hit, scores[place], 0.0) if len(scores) else np.zeros(len(distinct))
        sums = np.bincount(owner, score[at], len(rid))
        rare = ~hit[at]
        pairs, times = np.unique(owner[rare] * len(distinct) + at[rare], return_counts=True)
        docs, names = np.divmod(pairs, max(1, len(distinct)))
        # No window is negative, so a document's own row meets none and falls anywhere.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rid, rid[docs]])), pa.array(np.concatenate([-1 - rid, distinct[names]])),
             pa.array(np.concatenate([np.zeros(len(rid), np.int64), times])), pa.array(np.concatenate([sums, np.zeros(len(times))]))],
            names=["_rid", "_w", "_k", "_sum"])


def _spread(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """A row for each document's sums over frequent words, and one for each of its other words."""
    known = frequent.value
    schema = pa.schema([("_rid", pa.int64()), ("_word", pa.binary()), ("_k", pa.int64()), ("_n", pa.int64()), ("_seen", pa.int64()),
                        ("_base", pa.float64())])
    for batch in slices(batches, 256):
        rid, word, times, n_all, seen_all, base_all = [], [], [], [], [], []
        for r, text in zip(batch.column("_rid").to_pylist(), batch.column("_text")):
            words = tokens(text.as_py())
            seen, base, rare = 0, 0.0, []
            for w, k in Counter(words).items():
                f = known.get(w)
                if f is None:
                    rare.append((w, k))
                else:
                    seen += k
                    base += k * f
            # No word holds a line break, so this key meets no word and falls anywhere.
            rid += [r] * (1 + len(rare))
            word.append(b"\n%d" % r)
            word += [w for w, _ in rare]
            times.append(0)
            times += [k for _, k in rare]
            none = [0] * len(rare)
            n_all += [len(words), *none]
            seen_all += [seen, *none]
            base_all += [base, *none]
        columns = [rid, word, times, n_all, seen_all, base_all]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def score_windows(rows: DataFrame, order: int, across: bool) -> DataFrame:
    """(_w, _all, _lp): every window of `rows` (_text, _train), its occurrences and its log10 probability."""
    counts = written(rows.select("_text", "_train").mapInArrow(partial(_window_counts, order=order, across=across), "_w long, _c long, _all long")
                     .groupBy("_w").agg(F.sum("_c").alias("_c"), F.sum("_all").alias("_all")), "windows")
    # At most 65,792 edges, whatever the corpus.
    low = [counts.filter("_c > 0").groupBy(F.col("_w").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("_edge"))
           .agg(F.sum("_c").alias("_n")).select(F.lit(d).alias("_d"), "_edge", "_n") for d in (0, 1)]
    low = low[0].unionByName(low[1]).toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(low[c].to_numpy() for c in ("_d", "_edge", "_n")))
    groups = max(1, ceil(counts.count() / 100_000))
    near = F.pmod(F.xxhash64(F.shiftright("_w", 8).bitwiseAND(0xFFFF)), F.lit(groups)).alias("_b")
    scored = counts.select("*", near).groupBy("_b").applyInArrow(
        lambda table: _scored_windows(table, shared, order), "_w long, _all long, _lp double")
    return written(scored, "scored")


def score_documents(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 4,
                    frequent: int = 50_000, frequent_windows: int = 1 << 21, across: bool = False) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    `train` is a condition on `_id`, the row's id. `score` is the trie's log10 probability of the whole
    text, `base_score` that of a smoothed word count. With `across`, contexts reach over word ends.
    Null and empty texts are one end. Without training rows the trie gives each byte the same chance.
    Repeated rows count and are scored each; an empty table gives no rows. `order` is 6 at most.

    Words with at least one part in `frequent` of all training tokens, and windows with at least one
    part in `frequent_windows` of all coded bytes, are scored where the documents are; the lists are
    bounded by that arithmetic. All others of a document go, once each with their number, to the table
    of counts or scores, and none of those windows is frequent enough to be hot.
    """
    spark = df.sparkSession
    # Numbers of rows hold only once they are written: after a shuffle, or on another executor, they would come out otherwise.
    rows = written(texts(df, id_col, text_col, F.monotonically_increasing_id().alias("_rid")).withColumn("_train", train), "rows")
    counts = written(rows.select("_text", "_train").mapInArrow(_word_counts, "_word binary, _c long")
                     .groupBy("_word").agg(F.sum("_c").alias("_c")), "words")
    n, v = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count(F.when(F.col("_c") > 0, 1))).first()
    below = n + 0.5 * (v + 1)
    often = counts.filter((F.col("_c") > 0) & (F.col("_c") >= ceil(n / frequent))).toArrow()
    known = {w: log10((c + 0.5) / below) for w, c in zip(*[often[x].to_pylist() for x in ("_word", "_c")])}
    spread = rows.select("_rid", "_text").mapInArrow(
        partial(_spread, frequent=spark.sparkContext.broadcast(known)),
        "_rid long, _word binary, _k long, _n long, _seen long, _base double")
    c = F.coalesce("_c", F.lit(0))
    worded = spread.join(counts.hint("shuffle_hash"), "_word", "left").select(
        "_rid", "_n", (F.col("_seen") + F.when(c > 0, F.col("_k")).otherwise(0)).alias("_seen"),
        (F.col("_base") + F.col("_k") * F.log10((c + 0.5) / F.lit(below))).alias("_base"), F.lit(0.0).alias("_sum"))
    scored = score_windows(rows, order, across)
    least = ceil(scored.agg(F.coalesce(F.sum("_all"), F.lit(0))).first()[0] / frequent_windows)
    often = scored.filter(F.col("_all") >= least).select("_w", "_lp").toArrow().sort_by("_w")
    often = spark.sparkContext.broadcast(tuple(often[x].to_numpy() for x in ("_w", "_lp")))
    run = partial(_window_spread, frequent=often, order=order, across=across)
    places = rows.select("_rid", "_text").mapInArrow(run, "_rid long, _w long, _k long, _sum double")
    windowed = places.join(scored.filter(F.col("_all") < least).select("_w", "_lp").hint("shuffle_hash"), "_w", "left").select(
        "_rid", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_seen"), F.lit(0.0).alias("_base"),
        (F.col("_sum") + F.col("_k") * F.coalesce("_lp", F.lit(0.0))).alias("_sum"))
    sums = worded.unionByName(windowed).groupBy("_rid").agg(
        F.sum("_n").alias("n_tokens"), F.sum("_seen").alias("n_known"), F.sum("_base").alias("base_score"), F.sum("_sum").alias("score"))
    named = rows.select("_rid", F.col("_id").alias(id_col), F.col("_train").alias("train"))
    return named.join(sums, "_rid").select(
        f"`{id_col}`", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
