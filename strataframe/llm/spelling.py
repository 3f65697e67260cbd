"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One inserted or deleted letter changes the letter counts by one, one replaced letter by two, in L1
distance. So the near words of a word lie in a small box around its counts. The words of a length are
cut into leaves by a k-d tree over a sample; every word asks the leaves within reach of its own
length and the two beside it. In a leaf's task a finer tree prunes by boxes, and what is left is
compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import ceil, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import texts, written

#: Words are Latin-1 bytes inside the tasks: one byte a code point, in code-point order.
_RUNS = re.compile(rb"[a-z\xc0-\xff]+")
_LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
_HELD = 300_000
#: Lengths from here on share one class.
LONG = 64
_INNER = 48
_WALKED = 1 << 21
_TREES = 4096


def _word_counts(batches: Iterator[pa.RecordBatch], slip: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """Words of the texts with their counts; every `slip`-th run by checksum lacks one letter."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["_word", "_n"])

    for batch in batches:
        for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
            begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            # Characters beyond Latin-1 only separate.
            for run, n in Counter(_RUNS.findall(text.as_py().encode("latin-1", "replace").lower())).items():
                if len(run) < shortest:
                    continue
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                if not h % slip:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < shortest:
                        continue
                counts[run] += n
            if len(counts) > _HELD:
                yield flush()
                counts = Counter()
    yield flush()


def letter_counts(words: list[bytes]) -> np.ndarray:
    """How often each word holds each letter."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    place = np.zeros(256, np.int64)
    place[_LETTERS] = np.arange(len(_LETTERS))
    return np.bincount(row * len(_LETTERS) + place[flat], minlength=len(words) * len(_LETTERS)).reshape(-1, len(_LETTERS)).astype(np.float32)


def split_at(points: np.ndarray) -> tuple[int, float] | None:
    """The letter and the count that halve the points best: left are those with at most that many."""
    best = None
    for most in np.unique(points)[:-1].tolist():
        left = np.count_nonzero(points <= most, axis=0)
        odds = np.where((left > 0) & (left < len(points)), np.abs(2 * left - len(points)), len(points))
        letter = int(odds.argmin())
        if odds[letter] < (len(points) if best is None else best[0]):
            best = int(odds[letter]), letter, most
    return best and best[1:]


class Router:
    """A k-d tree over a sample: which leaf holds a word, and which leaves may hold words near it."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int] | int] = []
        self.leaves = 0
        self._grow(points, max(0, leaves - 1).bit_length())

    def _grow(self, points: np.ndarray, depth: int) -> int:
        number = len(self.nodes)
        self.nodes.append(self.leaves)
        cut = split_at(points) if depth and len(points) > 1 else None
        if cut is None:
            self.leaves += 1
            return number
        letter, most = cut
        low = points[:, letter] <= most
        left, right = self._grow(points[low], depth - 1), self._grow(points[~low], depth - 1)
        self.nodes[number] = (letter, most, left, right)
        return number

    def reach(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of points) for all leaves whose box is within `radius` of the points; 0 finds the own leaf."""
        dims = points.shape[1]
        stack = [(0, np.arange(len(points)), np.zeros(len(points), np.float32), np.full(dims, -np.inf, np.float32), np.full(dims, np.inf, np.float32))]
        while stack:
            number, own, far, low, high = stack.pop()
            if not len(own):
                continue
            node = self.nodes[number]
            if isinstance(node, int):
                yield node, own
                continue
            letter, most, left, right = node
            x = points[own, letter]
            was = np.maximum(0, np.maximum(low[letter] - x, x - high[letter]))
            for child, edge, side in ((left, most, high), (right, most + 1, low)):
                box = side.copy()
                box[letter] = edge
                now = np.maximum(0, x - edge if side is high else edge - x)
                distance = far - was + np.maximum(was, now)
                keep = distance <= radius
                stack.append((child, own[keep], distance[keep], *((low, box) if side is high else (box, high))))


def signatures(counts: np.ndarray) -> np.ndarray:
    """Letter counts in unary as 128 bits, so that differing bits are never more than the L1 distance.

    Letters a to z have four places each; the rest share 24 places, one each.
    """
    bits = np.zeros((len(counts), 128), bool)
    for k in range(4):
        bits[:, k * 26:(k + 1) * 26] = counts[:, :26] > k
    for letter in range(26, counts.shape[1]):
        bits[:, 104 + letter % 24] |= counts[:, letter] > 0
    return np.packbits(bits, axis=1).view(np.uint64)


class Words:
    """The words of one leaf as a k-d tree with tight boxes."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.lengths = np.array([len(w) for w in words])
        self.counts = letter_counts(words)
        self.bits = signatures(self.counts)
        #: Only letters in play take part in boxes; others are counted beside them.
        self.used = np.flatnonzero(self.counts.max(axis=0) > 0)
        self.order = np.arange(len(words))
        self.nodes: list[tuple] = []
        self._grow(np.ascontiguousarray(self.counts[:, self.used]), 0, len(words))

    def _grow(self, counts: np.ndarray, a: int, b: int) -> int:
        own = self.order[a:b]
        mine = counts[own]
        number = len(self.nodes)
        box = (a, b, mine.min(axis=0), mine.max(axis=0))
        self.nodes.append((*box, None, None))
        cut = split_at(mine[:: 1 + len(mine) // 4096]) if b - a > _INNER else None
        if cut:
            left = mine[:, cut[0]] <= cut[1]
            self.order[a:b] = np.concatenate([own[left], own[~left]])
            middle = a + int(left.sum())
            self.nodes[number] = (*box, self._grow(counts, a, middle), self._grow(counts, middle, b))
        return number

    def candidates(self, points: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of points, places of words) that are no further apart than `radius`, or seem so, in parts."""
        beside = points.sum(axis=1)
        points = np.ascontiguousarray(points[:, self.used])
        beside -= points.sum(axis=1)
        stack = [(0, np.flatnonzero(beside <= radius))]
        while stack:
            number, asked = stack.pop()
            a, b, low, high, left, right = self.nodes[number]
            inside = []
            for at in range(0, len(asked), 16_384):
                part = asked[at:at + 16_384]
                x = points[part]
                inside.append(part[np.maximum(np.maximum(low - x, x - high), 0).sum(axis=1) + beside[part] <= radius])
            asked = np.concatenate(inside) if inside else asked
            if not len(asked):
                continue
            if left is not None:
                stack += [(left, asked), (right, asked)]
                continue
            own = self.order[a:b]
            step = max(1, _WALKED // (b - a))
            for at in range(0, len(asked), step):
                part = asked[at:at + step]
                apart = np.bitwise_count(bits[part, None, 0] ^ self.bits[None, own, 0]) + np.bitwise_count(bits[part, None, 1] ^ self.bits[None, own, 1])
                i, j = np.nonzero(apart <= radius)
                yield part[i], own[j]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter leads from one to the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    first = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[first + (len(a) >= len(b)):] == b[first + (len(b) >= len(a)):]


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


def edited(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, whether words of equal length, or of which the right ones are one longer, are one edit apart."""
    short = left.shape[1]
    ahead = left != right[:, :short]
    if short == right.shape[1]:
        return ahead.sum(axis=1) == 1
    behind = left != right[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), short)
    last = np.where(behind.any(axis=1), short - behind[:, ::-1].argmax(axis=1), 0)
    return last <= first


def near_words(asked: list[bytes], held: Words) -> tuple[np.ndarray, np.ndarray]:
    """(places in asked, places in held) of all pairs one edit apart."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    points, lengths, sizes = letter_counts(asked), np.array([len(w) for w in asked]), held.lengths
    bits, tables = signatures(points), {}
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        own = _matrix([asked[r] for r in rows], length) if length < LONG else None
        for i, j in held.candidates(points[rows], bits[rows], 2 if (sizes == length).any() else 1):
            for size in (length - 1, length, length + 1):
                of_size = sizes[j] == size
                if not of_size.any():
                    continue
                a, b = i[of_size], j[of_size]
                if length >= LONG or size >= LONG:
                    right = np.array([one_edit(asked[rows[x]], held.words[y]) for x, y in zip(a.tolist(), b.tolist())], bool)
                else:
                    if size not in tables:
                        places = np.flatnonzero(sizes == size)
                        place = np.zeros(len(sizes), np.int64)
                        place[places] = np.arange(len(places))
                        tables[size] = place, _matrix([held.words[p] for p in places], size)
                    place, table = tables[size]
                    mine, theirs = own[a], table[place[b]]
                    right = edited(mine, theirs) if size >= length else edited(theirs, mine)
                found.append((rows[a[right]], b[right]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _class(length):
    return np.minimum(length, LONG)


def _routed(batches: Iterator[pa.RecordBatch], routers: dict[int, Router], parts: dict[tuple[int, int], int], asking: bool) -> Iterator[pa.RecordBatch]:
    """Each word in its own leaf, and where `asking`, as a question in all leaves that may hold near words."""
    for batch in batches:
        words, n = batch.column("_word").to_pylist(), batch.column("_n").to_numpy(zero_copy_only=False)
        if not words:
            continue
        points, lengths = letter_counts(words), np.array([len(w) for w in words])
        salt = np.array([zlib.crc32(w) for w in words])
        out = []
        for kind in sorted(set(_class(np.concatenate([lengths - 1, lengths, lengths + 1])).tolist()) & set(routers)):
            for radius, question, rows in ((0, False, _class(lengths) == kind), (2, True, lengths == kind), (2, True, (lengths > kind) & (kind == LONG)),
                                           (1, True, (lengths == kind + 1) & (kind < LONG)), (1, True, lengths == kind - 1)):
                rows = np.flatnonzero(rows)
                if question and not asking or not len(rows):
                    continue
                for leaf, own in routers[kind].reach(points[rows], radius):
                    split = parts.get((kind, leaf), 1)
                    for part in range(split):
                        mine = rows[own] if question or split == 1 else rows[own][salt[rows[own]] % split == part]
                        out.append((np.full(len(mine), kind), np.full(len(mine), leaf), np.full(len(mine), part), np.full(len(mine), question), mine))
        kind, leaf, part, question, row = (np.concatenate(c) for c in zip(*out))
        for at in range(0, len(row), 65_536):
            cut = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind[cut], pa.int64()), pa.array(leaf[cut], pa.int64()), pa.array(part[cut], pa.int64()), pa.array(question[cut], pa.bool_()),
                 batch.column("_word").take(pa.array(row[cut])), pa.array(n[row[cut]], pa.int64())], names=["_kind", "_leaf", "_part", "_asks", "_word", "_n"])


_ROUTED = "_kind long, _leaf long, _part long, _asks boolean, _word binary, _n long"


def _leaf(rows: pa.Table) -> pa.Table:
    """For every asking word: how many words of this leaf are near it, and which is the most frequent."""
    asks = rows["_asks"].to_numpy()
    words, n = rows["_word"].to_pylist(), rows["_n"].to_numpy()
    held = sorted(np.flatnonzero(~asks).tolist(), key=lambda k: words[k])
    asked = np.flatnonzero(asks)
    out: list[list] = [[], [], [], []]
    step = 1 << 17
    tree = Words([words[k] for k in held]) if held else None
    for at in range(0, len(asked) if held else 0, step):
        part = asked[at:at + step]
        i, j = near_words([words[k] for k in part], tree)
        if not len(i):
            continue
        size = n[held][j]
        order = np.lexsort((j, -size, i))
        i, j, size = i[order], j[order], size[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        out[0] += [words[part[k]] for k in i[first].tolist()]
        out[1] += np.diff(np.append(first, len(i))).tolist()
        out[2] += size[first].tolist()
        out[3] += [words[held[k]] for k in j[first].tolist()]
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({name: pa.array(c, k) for name, c, k in zip(("_word", "_near", "_form_n", "_form"), out, kinds)})


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, ratio: int = 10,
                      slip: int = 31, leaf_words: int = 20_000, sample_per_leaf: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least `shortest` letters that occurs `least` times.

    Words are runs of A to Z, a to z and U+00C0 to U+00FF, ASCII letters in lower case; a run whose
    crc32 with its row's id is divisible by `slip` lacks one letter. Near words are one inserted,
    deleted or replaced letter apart. A word's form is the near word of largest n, ties to the smaller
    in code-point order, if that n is at least `ratio` (over 1) times its own; its root is where forms end.

    A null id counts as the empty text, null and empty texts have no words, texts count whole, repeated
    rows count again, an empty table gives no rows, other columns play no part. The trees of a length
    are fitted on a sample, at most 4,096 leaves of `sample_per_leaf` words; leaves with far more words
    than meant are split, so every word is searched. Words are counted before they are dealt out.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their words")
    spark = df.sparkSession
    counted = texts(df, id_col, text_col).mapInArrow(partial(_word_counts, slip=slip, shortest=shortest), "_word binary, _n long")
    words = written(counted.groupBy("_word").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= least), "words")
    kind = F.least(F.length("_word"), F.lit(LONG)).alias("_kind")
    # One row a length, 64 at most.
    sizes = {r["_kind"]: (r["_words"], r["_most"]) for r in words.groupBy(kind).agg(F.count("*").alias("_words"), F.max("_n").alias("_most")).collect()}
    leaves = {k: min(_TREES, ceil(c / leaf_words)) for k, (c, _) in sizes.items()}
    many = {k: v for k, v in leaves.items() if v > 1}
    share = F.coalesce(*[F.when(kind == k, F.lit(min(1.0, sample_per_leaf * v / sizes[k][0]))) for k, v in many.items()], F.lit(0.0)) if many else None
    sample: dict[int, list[bytes]] = {}
    if many:
        picked = words.filter(F.pmod(F.xxhash64("_word", F.lit(7)), F.lit(1 << 30)) < share * float(1 << 30)).select("_word").toArrow()["_word"].to_pylist()
        for w in sorted(picked):
            sample.setdefault(min(len(w), LONG), []).append(w)
    routers = {k: Router(letter_counts(sample.get(k, [])) if sample.get(k) else np.zeros((0, len(_LETTERS)), np.float32), v) for k, v in leaves.items()}
    shared = spark.sparkContext.broadcast(routers)

    def route(batches, parts: dict, asking: bool):
        return _routed(batches, shared.value, parts, asking)

    counts = words.mapInArrow(partial(route, parts={}, asking=False), _ROUTED).groupBy("_kind", "_leaf").count().filter(F.col("count") > 2 * leaf_words)
    # Only leaves over twice the meant size: at most one in 2 * leaf_words words.
    parts = {(r["_kind"], r["_leaf"]): ceil(r["count"] / leaf_words) for r in counts.collect()}
    dealt = words.mapInArrow(partial(route, parts=parts, asking=True), _ROUTED)
    partly = dealt.groupBy("_kind", "_leaf", "_part").applyInArrow(_leaf, "_word binary, _near long, _form_n long, _form binary")
    near = partly.groupBy("_word").agg(F.sum("_near").alias("_near"), F.min(F.struct((-F.col("_form_n")).alias("_m"), "_form")).alias("_best"))
    joined = words.join(near, "_word", "left").select(
        "_word", "_n", F.coalesce("_near", F.lit(0).cast("long")).alias("n_near"),
        *[F.when(-F.col("_best._m") >= ratio * F.col("_n"), c).alias(a) for c, a in ((F.col("_best._form"), "_form"), (-F.col("_best._m"), "form_n"))])
    joined = written(joined, "forms")
    roots = joined.filter("_form is not null").select("_word", F.col("_form").alias("_root"))
    # n grows by `ratio` with every form, which bounds the chains; each round doubles how far a root lies.
    longest = 1 + int(log10(max((m for _, m in sizes.values()), default=1)) / log10(ratio))
    for _ in range(longest.bit_length()):
        onward = roots.select(F.col("_word").alias("_root"), F.col("_root").alias("_next"))
        roots = written(roots.join(onward, "_root", "left").select("_word", F.coalesce("_next", "_root").alias("_root")), "roots")

    def text(name: str):
        return F.decode(F.col(name), "ISO-8859-1")

    return joined.join(roots, "_word", "left").select(
        text("_word").alias("word"), text("_form").alias("form"), text("_root").alias("_r"), "_n", "n_near", "form_n").select(
        "word", "form", F.coalesce("_r", "word").alias("root"), F.col("_n").alias("n"), "n_near", "form_n")
