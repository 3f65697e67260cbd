"""BPE by speculation: longest matches are proposed, every adjacent pair is verified, failures are merged exactly."""

from __future__ import annotations

import gc
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataframe.llm.common import ship, slices, texts

# Distinct words a worker remembers, and their characters, before it makes room; words learned at a time.
REMEMBERED, CHARACTERS, AT_ONCE = 300_000, 8_000_000, 65_536


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def recent() -> np.ndarray:
    """For each code point, whether Unicode 3.2 had not assigned it.

    Libraries follow different later versions, so they compose, lower and class such characters
    differently; what was assigned by then has not changed since.
    """
    return np.array([unicodedata.ucd_3_2_0.category(chr(c)) == "Cn" for c in range(0x110000)])


class WordBpe:
    """Vocabulary, merges and text rules of one tokenizer file, with word ends and a splitting pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.ids: dict[str, int] = model["vocab"]
        self._order(model["merges"])
        # The longest token that begins with given four characters, or given fewer.
        self.reach: dict[str, int] = {}
        for name in self.proposed:
            name = name.removesuffix(self.end) if self.end else name
            self.reach[name[:4]] = max(self.reach.get(name[:4], 1), len(name))
        # Numbers of single characters of the byte alphabet, inside a word and at its end.
        self.inside, self.final = np.full(512, -1), np.full(512, -1)
        for c in self.alphabet.values():
            self.inside[ord(c)] = self.number.get(c, -1)
            self.final[ord(c)] = self.number.get(c + self.end, -1)
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.path, self.library = path, None

    def _order(self, merges: list) -> None:
        """Numbers tokens so that each merge makes a number above both of its parts' ranks."""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        made = {}
        for k, (a, b) in enumerate(merges):
            made.setdefault(a + b, k)
        base = [n for n in self.ids if n not in made]
        self.first_merge = len(base)
        self.number = {n: i for i, n in enumerate(base)} | {n: len(base) + k for n, k in made.items()}
        size = len(base) + len(merges)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.pairs: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            self.left[len(base) + k], self.right[len(base) + k] = self.number[a], self.number[b]
            self.pairs.setdefault((self.number[a], self.number[b]), len(base) + k)
        self.size = size
        keys = np.array([a * size + b for a, b in self.pairs], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[by], np.array(list(self.pairs.values()), np.int64)[by]
        # Two merges that make the same text are told apart by the exact way only.
        self.made_number = {len(base) + k: self.number[a + b] for k, (a, b) in enumerate(merges)}
        self.made_numbers = np.arange(size)
        for i, made_as in self.made_number.items():
            self.made_numbers[i] = made_as
        own = np.arange(len(base), size)
        alike = np.array([self.made_number[i] != i for i in own]) if len(own) else np.zeros(0, bool)
        valid = np.ones(size, bool)
        valid[own] = self.compatible(self.left[own], self.right[own], own) & ~alike
        for i in own:
            valid[i] &= valid[self.left[i]] and valid[self.right[i]]
        self.proposed = {n: i for n, i in self.number.items() if valid[i]}
        self.to_id = np.full(size, -1, np.int32)
        for n, i in self.number.items():
            self.to_id[i] = self.ids[n]

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], self.size + 1)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the joined text of each pair leaves exactly that pair.

        The later-made side is taken apart step by step; a merge across the seam that would have come
        before the side was complete breaks the pair.
        """
        ok = np.ones(len(a), bool)
        rows, a, b = np.arange(len(a)), np.array(a, np.int64), np.array(b, np.int64)
        limit = np.full(len(a), self.size, np.int64) if limit is None else np.array(limit, np.int64)
        while len(rows):
            crosses = self._merged(a, b) < limit
            ok[rows[crosses]] = False
            open_left = (a > b) & (a >= self.first_merge)
            # A part without merges cannot be opened; then the other side is.
            open_right = ~open_left & (b >= self.first_merge)
            open_left |= ~open_right & (a >= self.first_merge)
            limit = np.where(open_left, a, np.where(open_right, b + 1, limit))
            a, b = np.where(open_left, self.right[a], a), np.where(open_right, self.left[b], b)
            keep = ~crosses & (open_left | open_right)
            rows, a, b, limit = rows[keep], a[keep], b[keep], limit[keep]
        return ok

    def speculate(self, word: str) -> list[int] | None:
        """Greedy longest matches from the left, or None where some character has none."""
        out, at, n, names, end, reach = [], 0, len(word), self.proposed, self.end, self.reach
        while at < n:
            size = min(reach.get(word[at:at + 4], 3), n - at)
            while size:
                found = names.get(word[at:at + size] + end if at + size == n else word[at:at + size])
                if found is not None:
                    break
                size -= 1
            else:
                return None
            out.append(found)
            at += size
        return out

    def merge_many(self, words: list[str], width: int = 24) -> list[list[int]]:
        """The exact way for many words at once, a row each; words longer than `width` go one by one."""
        out = [self.merge(w) if len(w) > width else None for w in words]
        short = np.array([i for i, ts in enumerate(out) if ts is None], np.int64)
        short = short[np.argsort([len(words[i]) for i in short], kind="stable")]
        for at in range(0, len(short), 4096):
            group = short[at:at + 4096]
            for i, row in zip(group.tolist(), self._merge_rows([words[i] for i in group])):
                out[i] = row
        return out

    def _merge_rows(self, words: list[str]) -> list[list[int]]:
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes) - 1
        flat = self.inside[codes]
        flat[ends] = self.final[codes[ends]]
        width = int(sizes.max())
        parts = np.full((len(words), width + 1), -1)
        parts[np.arange(width + 1) < sizes[:, None]] = flat
        none = self.size + 1

        def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where((a >= 0) & (b >= 0), self._merged(a, b), none)

        ranks = ranked(parts[:, :-1], parts[:, 1:])
        rows, columns = np.arange(len(words)), np.arange(width)
        while len(rows):
            best = ranks[rows].argmin(axis=1)
            rank = ranks[rows, best]
            more = rank < none
            rows, best, rank = rows[more], best[more], rank[more]
            if not len(rows):
                break
            # What stands behind the merged pair moves up by one.
            behind = columns[None, :] > best[:, None]
            moved = parts[rows]
            moved[:, :-1] = np.where(behind, moved[:, 1:], moved[:, :-1])
            moved[np.arange(len(rows)), best] = self.made_numbers[rank]
            parts[rows] = moved
            close = ranks[rows]
            close[:, :-1] = np.where(behind[:, :-1], close[:, 1:], close[:, :-1])
            at, before = np.arange(len(rows)), np.maximum(best - 1, 0)
            close[at, best] = ranked(moved[at, best], moved[at, best + 1])
            close[at, before] = ranked(moved[at, before], moved[at, before + 1])
            ranks[rows] = close
        return [row[row >= 0].tolist() for row in parts]

    def merge(self, word: str) -> list[int]:
        """The exact way for one word: the earliest merge first, leftmost on ties."""
        parts = [self.number.get(c) for c in [*word[:-1], word[-1] + self.end]]
        parts = [p for p in parts if p is not None]
        return self._merge_long(parts) if len(parts) > 64 else self._merge_short(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        """Looks through all pairs for the next merge."""
        get, none = self.pairs.get, self.size
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            parts[i:i + 2] = [self.made_number[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same over a linked list and a heap, so that one endless word stays near linear."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or self.pairs.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = self.made_number[rank], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (parts[x], parts[y]) in self.pairs:
                    heapq.heappush(heap, (self.pairs[parts[x], parts[y]], x))
        return [p for p in parts if p is not None]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Order numbers of each word's tokens."""
        tokens = [self.speculate(w) for w in words]
        flat = np.array([t for ts in tokens if ts for t in ts], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(ts) if ts else 0 for ts in tokens])
        if len(flat) > 1:
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            fits = self.compatible(pairs // self.size, pairs % self.size)[back]
            for i in np.unique(owner[inside[~fits]]):
                tokens[i] = None
        failed = [i for i, ts in enumerate(tokens) if ts is None]
        for i, ts in zip(failed, self.merge_many([words[i] for i in failed])):
            tokens[i] = ts
        return tokens

    def words_of(self, chunk: str) -> list[str | int]:
        """Normalised words of a chunk in the byte alphabet; special tokens come as their ids."""
        out, at = [], 0
        for m in self.split_special.finditer(chunk) if self.split_special else ():
            out += [*self._words(self._normal(chunk[at:m.start()])), self.special[m[0]]]
            at = m.end()
        return out + self._words(self._normal(chunk[at:]))

    def _normal(self, text: str) -> str:
        # Letters are lowered one by one, so sigma has no form of its own at the end of a word.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            if text.isalpha():
                return [text]
            # Most words that are not letters alone end in one mark.
            if text[-1:] in (",", ".", "!", "?") and text[:-1].isalpha():
                return [text[:-1], text[-1]]
        return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.alphabet)
                for w in self.pattern.findall(text)]

    def library_ids(self, chunk: str) -> bytes:
        """Ids by the tokenizers library."""
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, np.int32).tobytes()

    def learn(self, new: list[str]) -> None:
        """Adds the ids of new space-delimited chunks to the cache; the library's, where versions of Unicode matter."""
        chunks, joined = new, " ".join(new)
        if not joined.isascii():
            at = np.flatnonzero(recent()[np.frombuffer(joined.encode("utf-32-le"), "<u4")])
            if len(at):
                ends = np.cumsum([len(c) + 1 for c in new])
                odd = set(np.searchsorted(ends, at, side="right").tolist())
                self.cache.update((new[i], self.library_ids(new[i])) for i in odd)
                chunks = [c for i, c in enumerate(new) if i not in odd]
                joined = " ".join(chunks)
        if not chunks:
            return
        if self.split_special and self.split_special.search(joined):
            split = [self.words_of(c) for c in chunks]
        else:
            # Neither composing nor lowering makes or removes a space.
            split = [self._words(c) for c in self._normal(joined).split(" ")]
        met = {w for ws in split for w in ws if isinstance(w, str)}
        # A known chunk of plain small letters is a word of its own, and met again inside other chunks.
        ids = {w: self.cache[w] for w in met & self.cache.keys() if w.isascii() and w.isalpha()}
        words = [w for w in met if w not in ids]
        tokens = self.encode_words(words)
        flat, at = self.to_id[np.array([t for ts in tokens for t in ts], np.int64)].tobytes(), 0
        for w, ts in zip(words, tokens):
            ids[w] = flat[at:at + 4 * len(ts)]
            at += 4 * len(ts)
        for c, ws in zip(chunks, split):
            self.cache[c] = ids[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else b"".join(
                [ids[w] if isinstance(w, str) else np.int32(w).tobytes() for w in ws])

    def remember(self, chunks: set[str]) -> None:
        """Learns what is new; what was known before and is not asked for makes room when there is too much."""
        new = [c for c in chunks if c not in self.cache]
        if not new:
            return
        self.held += sum(map(len, new))
        if len(new) + len(self.cache) > REMEMBERED or self.held > CHARACTERS:
            self.cache = {c: self.cache[c] for c in chunks if c in self.cache}
            self.held = sum(map(len, chunks))
        # Nothing made here refers to itself, and looking for cycles in it takes long.
        gc.disable()
        try:
            for at in range(0, len(new), AT_ONCE):
                self.learn(new[at:at + AT_ONCE])
        finally:
            gc.enable()

    def encode_batch(self, values: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of four bytes."""
        # No word, special token or composed character holds a space. New words of all texts are
        # proposed and verified together, unless there are too many.
        together: set[str] = set()
        for text in values:
            together.update(text.split(" "))
        many = len(together) > REMEMBERED or sum(map(len, together)) > CHARACTERS
        if many:
            del together
        else:
            self.remember(together)
        out = []
        for text in values:
            chunks = text.split(" ")
            if many:
                self.remember(set(chunks))
            out.append(b"".join(map(self.cache.__getitem__, chunks)))
        return out


@lru_cache(maxsize=2)
def token_names(path: str) -> pa.Array:
    """The text of every id; ids that no token has are null."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    ids = config["model"]["vocab"] | {t["content"]: t["id"] for t in config["added_tokens"]}
    names: list[str | None] = [None] * (1 + max(ids.values()))
    for name, i in ids.items():
        names[i] = name
    return pa.array(names, pa.string())


def decode(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """Token texts joined by spaces, as tokenizers without a decoder do; unknown ids are left out."""
    flat, starts = ids.flatten(), ids.offsets
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), False)
    texts_ = names.take(pc.if_else(known, flat, None))
    if texts_.null_count or ids.null_count or starts[0].as_py():
        rows = [None if r is None else [i for i in r if i is not None and 0 <= i < len(names) and names[i].is_valid] for r in ids.to_pylist()]
        lists = pa.array(rows, pa.list_(pa.int32()))
        texts_, starts = names.take(lists.flatten()), lists.offsets
        joined = pc.binary_join(pa.ListArray.from_arrays(starts, texts_), " ")
        return pc.if_else(pc.is_valid(lists), joined, None)
    return pc.binary_join(pa.ListArray.from_arrays(starts, texts_), " ")


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in slices(batches, 2048):
        data = bpe.encode_batch(batch.column("_text").to_pylist())
        offsets = np.zeros(len(data) + 1, np.int64)
        np.cumsum([len(d) // 4 for d in data], out=offsets[1:])
        ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(data))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)], names=["_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    names = token_names(path)
    for batch in slices(batches, 1024):
        # A slice's lists are made anew, so that they begin at zero.
        column = batch.column(ids_col)
        text = decode(pa.concat_arrays([column]) if column.offset == 0 else column.take(pa.array(range(len(column)), pa.int64())), names)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns)], text],
                                         names=[*batch.schema.names, "decoded"])


def encode_bpe(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row, by the word-end tokenizer file at `path` on each executor.

    Special tokens in a text give their ids; runs between spaces that hold a character newer than
    Unicode 3.2 are encoded by the tokenizers library, whatever its version of Unicode. Null and empty texts have no ids; repeated rows keep a
    row each; other columns are not read. One pass, no shuffle; a worker remembers a bounded number
    of words, and time is near linear in the length of a text even if it is one word.
    """
    rows = texts(df, id_col, text_col)
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, ids array<int>"
    return rows.mapInArrow(partial(_encoded, path=path), schema).withColumnRenamed("_id", id_col)


def decode_bpe(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`df` with `decoded`, the text of `ids_col`; null ids give null. A column of that name is replaced."""
    ship(df.sparkSession)
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c != "decoded"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(partial(_decoded, path=path, ids_col=ids_col), f"{fields}, decoded string")
