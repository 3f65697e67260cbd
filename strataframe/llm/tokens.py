"""Fast byte-level BPE ids for the operators that only need them, equal to those of the tokenizers library."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from strataframe.llm.bpe import byte_alphabet

# Fixed value: the words of byte-level vocabularies, in the form that tiktoken gives for them: the same words, with less backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# Kinds of characters that the pattern tells apart.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# Characters split at a time; distinct words a worker remembers, and their ids, before it makes room.
AT_ONCE, REMEMBERED, REMEMBERED_IDS = 1 << 21, 300_000, 2_000_000


class ByteBpe:
    """Ids of whole texts; special tokens in a text give their ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in config["added_tokens"]}
        ranks = {bytes(back[c] for c in name): i for name, i in config["model"]["vocab"].items() if name not in special}
        self.fast = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain = Tokenizer.from_file(path)
        self.vocabulary = 1 + max([*ranks.values(), *special.values()])
        # Words that are cut already, with zeros between them; texts that hold zeros or special tokens go alone.
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens=special)
        self.apart = ["\0", *special]
        # What a pattern does not match gives no ids, so these keep the characters of one kind, as the library classes them.
        self.kinds = {kind: tiktoken.Encoding(f"kind{kind}", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
                      for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))}
        self.kind = np.zeros(0x110000, np.uint8)
        self.known = pa.array([], pa.binary())
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Unsigned ids. The two libraries agree on every code point; only one of them is fast enough."""
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        except ValueError:  # long runs of white space exhaust the pattern's stack
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The same ids for each of many texts: they are cut into words together, and each distinct word is encoded once."""
        held: list[str] = []
        size = 0
        for text in texts:
            alone = len(text) > AT_ONCE or any(s in text for s in self.apart)
            if held and (alone or size + len(text) > AT_ONCE):
                yield from self._encode_held(held)
                held, size = [], 0
            if alone:
                yield self.encode(text)
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._encode_held(held)

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kind[codes]
        if not kinds.all():
            new = np.unique(codes[kinds == 0])
            self.kind[new] = OTHER
            joined = new.astype("<u4").tobytes().decode("utf-32-le")
            for kind, only in self.kinds.items():
                self.kind[[ord(c) for c in only.decode(only.encode_ordinary(joined))]] = kind
            kinds = self.kind[codes]
        return kinds

    def _words(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where the pattern's matches begin in texts that lie one behind another, each beginning at one of `firsts`."""
        kinds = self._kinds(codes)
        space, first = kinds == SPACE, np.zeros(len(codes) + 1, bool)
        first[firsts] = True
        begins = first.copy()
        # Runs of one kind; a blank belongs to what follows it.
        begins[1:-1] |= (kinds[1:] != kinds[:-1]) & ((codes[:-1] != 32) | space[1:])
        # The last of several spaces stands apart, unless the text ends with it.
        begins[1:-2] |= space[1:-1] & space[:-2] & ~space[2:] & ~first[2:-1]
        # 's and its like, where a match begins with the mark.
        marks = np.flatnonzero(codes == 39)
        marks = marks[begins[marks]]
        end = len(codes)
        one, two = codes[np.minimum(marks + 1, end - 1)], codes[np.minimum(marks + 2, end - 1)]
        short = np.isin(one, [ord(c) for c in "sdmt"])
        long = ~first[np.minimum(marks + 2, end)] & ((one == 108) & (two == 108) | ((one == 118) | (one == 114)) & (two == 101))
        own = ~first[marks + 1] & (short | long)
        marks, size = marks[own], np.where(short, 2, 3)[own]
        begins[marks + 1] = False
        begins[marks + size] = True
        return np.flatnonzero(begins[:-1])

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered words, one word behind another, and where each ends."""
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[number] - ends + sizes, sizes) + np.arange(sizes.sum())], ends

    def _encode_words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for distinct words."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b"\0")[0].as_py().decode()
        ids = self.words.encode_to_numpy(joined, disallowed_special=())
        marks = np.flatnonzero(ids == self.words.encode_single_token(b"\0"))
        return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def _numbers(self, words: pa.BinaryArray) -> np.ndarray:
        """Each word's place among those remembered; what is new is learned, and what is not asked for makes room."""
        # Remembered words come first, so they keep their places.
        found = pa.chunked_array([self.known, words]).dictionary_encode().chunks[-1]
        number, n = found.indices.to_numpy(), len(self.known)
        self.known = found.dictionary
        if len(self.known) > n:
            ids, sizes = self._encode_words(self.known.slice(n))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes, self.ids = np.append(self.sizes, sizes), np.append(self.ids, ids)
        if len(self.known) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            asked = np.bincount(number, minlength=len(self.known)) > 0
            kept, number = np.flatnonzero(asked), (np.cumsum(asked) - 1)[number]
            self.known, (self.ids, ends) = self.known.take(pa.array(kept)), self._gather(kept)
            self.sizes = self.sizes[kept]
            self.starts = ends - self.sizes
        return number

    def _encode_held(self, texts: list[str]) -> Iterator[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        raw = joined.encode()
        ascii_only = len(raw) == len(joined)
        codes = np.frombuffer(raw, np.uint8) if ascii_only else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        bounds = np.append(0, np.cumsum([len(t) for t in texts]))
        begins = self._words(codes, bounds)
        # Bytes that begin a character are those that do not go on with one.
        at = begins if ascii_only else np.flatnonzero(np.frombuffer(raw, np.int8) >= -64)[begins]
        # The words lie one behind another in the text, so it is their buffer.
        offsets = np.append(at, len(raw)).astype(np.int32)
        ids, ends = self._gather(self._numbers(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])))
        cuts = np.append(0, ends)[np.searchsorted(begins, bounds)]
        yield from (ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
