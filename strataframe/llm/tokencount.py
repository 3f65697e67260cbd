"""Token counts by a compiled transducer: a vocabulary becomes states and transitions that carry counts.

Byte-pair encoding by piece scores has one property that makes it finite: a sequence of pieces is the
encoding of its text if and only if every two neighbours are the encoding of their own text. So the
last piece of a text that grows by one character follows from the pieces before its last few places.
A state is the list of those places: how far the text from there on reads into a piece, which piece
ends there, and how many pieces lie behind it. A transition on a character leads to the next state
and carries the change of the piece count. States and transitions are compiled when first met.

Texts are cut into chunks that advance side by side. A chunk that begins where a piece must begin maps
every state alike; the others map the states they are asked for. A prefix scan composes the maps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import slices, texts

SPACE = "▁"
_FRESH, _KNOWN = 0, 5  # symbols below _KNOWN begin anew: a space after another character, characters outside the vocabulary by bytes
_START = 0
_STATES = 400_000
_PIECE = 1 << 20
_SPREAD = 0x9E3779B97F4A7C15


class Transducer:
    """The states and transitions of one vocabulary, compiled as texts ask for them."""

    def __init__(self, scores: dict[str, float], chunk: int = 256, most_states: int = _STATES):
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("pieces must not reach over the start of a word")
        self.scores, self.chunk, self.most_states = scores, chunk, most_states
        characters = sorted({c for p in scores for c in p})
        self.characters = characters
        self.space = _KNOWN + characters.index(SPACE)
        code = np.array([1, 2, 3, 4], np.int16).repeat([0x80, 0x780, 0xF800, 0x100000])
        code[[ord(c) for c in characters]] = _KNOWN + np.arange(len(characters))
        code[0x20] = self.space
        self.symbol_of = code
        # The trie of all pieces that are their own encoding; no other piece ever comes out.
        self.child: list[dict[int, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in scores:
            if len(p) > 1 and self.merge(p) != [p]:
                continue
            v = 0
            for c in p:
                s = int(code[ord(c)])
                if s not in self.child[v]:
                    self.child[v][s] = len(self.child)
                    self.child.append({})
                    self.piece.append(None)
                v = self.child[v][s]
            self.piece[v] = p
        self.forget()

    def forget(self) -> None:
        """Begins anew with the start state alone; what was compiled can always be compiled again."""
        self.keys: list[tuple] = []
        self.names: dict[tuple, int] = {}
        self.agree: dict[tuple[str, str], bool] = {}
        self.used = 0
        self._room(1 << 16)
        self.name(((0, None, 0),))
        for size in (1, 2, 3, 4):
            self._put(_START << 16 | size, _START, size)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scored neighbours merge, the leftmost of equals first."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in pairs if s is not None), default=None)
            if best is None:
                break
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def name(self, key: tuple) -> int:
        number = self.names.get(key)
        if number is None:
            number = self.names[key] = len(self.keys)
            self.keys.append(key)
        return number

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the count. Exactly one piece can end here and fit the one before it."""
        after, ends = [], None
        for node, before, behind in self.keys[state]:
            child = self.child[node].get(symbol)
            if child is None:
                continue
            piece = self.piece[child]
            if piece is not None and ends is None and self._fits(before, piece):
                ends, change = piece, 1 - behind
            if self.child[child]:
                after.append((child, before, behind))
        key = (*((node, before, behind + change) for node, before, behind in after), (0, ends, 0))
        return self.name(key), change

    def _fits(self, before: str | None, piece: str) -> bool:
        if before is None:
            return True
        known = self.agree.get((before, piece))
        if known is None:
            known = self.agree[before, piece] = self.merge(before + piece) == [before, piece]
        return known

    # Transitions lie in an open hash table, so that a step of all chunks is a few array operations.

    def _room(self, size: int) -> None:
        old = [(k, t, c) for k, t, c in zip(self.slot_keys, self.slot_next, self.slot_change) if k >= 0] if self.used else []
        self.slot_keys = np.full(size, -1, np.int64)
        self.slot_next, self.slot_change = np.zeros(size, np.int32), np.zeros(size, np.int8)
        self.shift, self.used = 65 - size.bit_length(), 0
        for k, t, c in old:
            self._put(int(k), int(t), int(c))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(self.shift)).view(np.int64)

    def _put(self, key: int, target: int, change: int) -> None:
        if 2 * self.used >= len(self.slot_keys):
            self._room(2 * len(self.slot_keys))
        at, last = (key * _SPREAD & 0xFFFFFFFFFFFFFFFF) >> self.shift, len(self.slot_keys) - 1
        while self.slot_keys[at] >= 0:
            at = (at + 1) & last
        self.slot_keys[at], self.slot_next[at], self.slot_change[at] = key, target, change
        self.used += 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of transitions, compiled first where they are new."""
        at, last = self._slots(keys), len(self.slot_keys) - 1
        held = self.slot_keys[at]
        odd = np.flatnonzero(held != keys)
        new = []
        while len(odd):
            new.append(odd[held[odd] < 0])
            odd = odd[held[odd] >= 0]
            at[odd] = (at[odd] + 1) & last
            held[odd] = self.slot_keys[at[odd]]
            odd = odd[held[odd] != keys[odd]]
        new = np.concatenate(new) if new else np.zeros(0, np.int64)
        if not len(new):
            return at
        for key in np.unique(keys[new]).tolist():
            self._put(key, *self.compile(key >> 16, key & 0xFFFF))
        if last + 1 != len(self.slot_keys):
            return self._find(keys)
        at[new] = self._find(keys[new])
        return at

    def _advance(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs chunks side by side from their states: end states and counts."""
        order = np.argsort(-length, kind="stable")
        at, state, count = begin[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        left = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
        for step, active in enumerate(left.tolist()):
            symbol = symbols[at[:active] + step]
            slot = self._find((state[:active] * (symbol >= _KNOWN)) << 16 | np.where(symbol == _FRESH, self.space, symbol))
            state[:active] = self.slot_next[slot]
            count[:active] += self.slot_change[slot]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def _counts(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Piece counts of the texts that begin at `starts`, each with a fresh symbol."""
        ends = np.append(starts[1:], len(symbols))
        # Chunks begin at texts and every so many symbols, moved on to where a piece must begin, if near.
        fresh = np.flatnonzero(symbols < _KNOWN)
        inner = np.concatenate([np.arange(a + self.chunk, b, self.chunk) for a, b in zip(starts, ends) if b - a > self.chunk] or [np.zeros(0, np.int64)])
        near = fresh[np.minimum(np.searchsorted(fresh, inner), len(fresh) - 1)] if len(fresh) else inner
        text_end = ends[np.searchsorted(starts, inner, "right") - 1]
        moved = np.where((near >= inner) & (near < np.minimum(inner + self.chunk, text_end)), near, inner)
        begin = np.unique(np.concatenate([starts, moved]))
        length = np.diff(np.append(begin, len(symbols)))
        known = symbols[begin] < _KNOWN
        text = np.searchsorted(starts, begin, "right") - 1
        # Entries of the chunks' maps: from a state to another, with a count. Guesses for open chunks come
        # from the symbols just before them.
        state = np.zeros(len(begin), np.int64)
        opened = np.flatnonzero(~known)
        if len(opened):
            back = np.minimum(32, begin[opened] - begin[opened - 1])
            state[opened] = self._advance(symbols, begin[opened] - back, back, np.zeros(len(opened), np.int64))[0]
        chunk = np.arange(len(begin))
        end, count = self._advance(symbols, begin, length, state)
        while True:
            entry = {(c, s): e for e, (c, s) in enumerate(zip(chunk.tolist(), state.tolist())) if not known[c]} if len(opened) else {}
            after = chunk + 1
            follows = (after < len(begin)) & ~known[np.minimum(after, len(begin) - 1)]
            link, missing = np.arange(len(chunk)), []
            for e in np.flatnonzero(follows).tolist():
                link[e] = entry.get((int(after[e]), int(end[e])), e)
                if link[e] == e:
                    missing.append(e)
            # The scan: composing the maps of 1, 2, 4, ... chunks marks the entries that texts pass through.
            live, jump = known[chunk].copy(), link
            for _ in range(len(begin).bit_length()):
                live[jump[live]] = True
                jump = jump[jump]
            asked = sorted({(int(after[e]), int(end[e])) for e in missing if live[e]})
            if not asked:
                return np.bincount(text[chunk[live]], count[live], len(starts)).astype(np.int64)
            more = np.array(asked)
            e, c = self._advance(symbols, begin[more[:, 0]], length[more[:, 0]], more[:, 1])
            chunk, state = np.concatenate([chunk, more[:, 0]]), np.concatenate([state, more[:, 1]])
            end, count = np.concatenate([end, e]), np.concatenate([count, c])

    def counts(self, batch: list[str]) -> list[int]:
        """Pieces of each text."""
        out, held, size = [], [], 0
        for text in batch:
            if held and size + len(text) > _PIECE:
                out += self._together(held)
                held, size = [], 0
            held.append(text)
            size += len(text) + 1
        return out + self._together(held)

    def _together(self, batch: list[str]) -> list[int]:
        if len(self.keys) > self.most_states:
            self.forget()
        full = np.array([bool(t) for t in batch], bool)
        if not full.any():
            return [0] * len(batch)
        # A space goes before each text, and a zero byte count before an empty one cannot arise.
        joined = np.frombuffer("".join(" " + t for t in batch if t).encode("utf-32-le"), "<u4")
        symbols = self.symbol_of[joined]
        sizes = np.array([len(t) + 1 for t in batch if t])
        starts = np.cumsum(sizes) - sizes
        space = symbols == self.space
        lone = space & ~np.append(False, space[:-1])
        lone[starts] = True
        symbols[lone] = _FRESH
        counts = np.zeros(len(batch), np.int64)
        counts[full] = self._counts(symbols, starts)
        return counts.tolist()


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """The transducer of a sentencepiece model of byte-pair kind that leaves texts as they are."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    probe = "  Aﬁ \téé　 "
    if model.decode(model.encode(probe)) != probe or not model.is_byte(model.piece_to_id("<0x00>")):
        raise ValueError("the model normalises texts or has no bytes")
    return Transducer(scores)


def _counted(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    transducer = load(model)
    for batch in slices(batches, 1024):
        counts = transducer.counts(batch.column("_text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_bytes"), pa.array(counts, pa.int64())], names=["_id", "n_bytes", "n_tokens"])


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: UTF-8 bytes, and tokens as the sentencepiece model at `model` gives them.

    No begin, end or other special tokens are added, and their names inside texts are ordinary text.
    Null and empty texts have no tokens; texts of any length are counted whole; a null id stays null;
    repeated rows are counted one by one; an empty table gives no rows; other columns of `df`, of
    whatever name, play no part. There is no shuffle. A worker holds the states that it has met, some
    400,000 at most besides those of the texts at hand, and begins anew beyond that.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = texts(df, id_col, text_col).withColumn("_bytes", F.octet_length("_text").cast("long"))
    run = partial(_counted, model=model)
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)
