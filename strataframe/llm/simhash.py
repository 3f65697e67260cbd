"""Near copies by SimHash: fingerprints of word shingles, compared bit-sliced within buckets, joined into groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import texts, written

BITS = 64
SEED = 42
TILE = 4096
_STEP = 1 << 16


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    # bytes.lower and bytes.split know ASCII only, which is what the fingerprint is defined on.
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    parts = zip(*[words[i:] for i in range(shingle)])
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it; no hashes give zero."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[i:i + _STEP])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column("_text")], np.uint64)
        keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], pa.array(found.view(np.int64), pa.int64())],
            names=[*[batch.schema.names[i] for i in keep], "_fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(_id, _fp) of every row; null text counts as empty, whose fingerprint is zero."""
    rows = texts(df, id_col, text_col)
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), f"_id {rows.schema['_id'].dataType.simpleString()}, _fp long")


def near(fps: np.ndarray, radius: int) -> np.ndarray:
    """Packed matrix (row, word of 64 columns) of the pairs within `radius` bits, itself included.

    The fingerprints are stored vertically, one plane of packed bits per bit position. The distances
    of 64 pairs grow at once in carry-save counters, and a row whose pairs have all left the radius
    is given up.
    """
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((words * 64, BITS), np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)
    real = np.zeros(words * 64, np.uint8)
    real[:n] = 1
    out = np.packbits(real, bitorder="little").view(np.uint64)
    found = np.zeros((n, words), np.uint64)
    rows = np.arange(n)
    size = max(1, int(radius).bit_length())
    counters = [np.zeros((n, words), np.uint64) for _ in range(size)]
    over = np.broadcast_to(~out, (n, words)).copy()
    for b in range(BITS):
        flip = np.where(bits[rows, b].astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        carry = planes[b][None, :] ^ flip[:, None]
        for c in counters:
            carry, c[...] = c & carry, c ^ carry
        over |= carry | _above(counters, radius)
        if b % 8 == 7:
            alive = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
            if not alive.all():
                rows, over, counters = rows[alive], over[alive], [c[alive] for c in counters]
                if not len(rows):
                    break
    found[rows] = ~over
    return found


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counters, lowest bit first, hold more than `radius`."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def stars(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links (fingerprint, smallest of its group) within one block; as many as it has members at most."""
    fps = np.unique(fps)
    links = near(fps, radius)
    seen = np.zeros(len(fps), bool)
    left, right = [], []
    several = np.bitwise_count(links).sum(axis=1) > 1
    for s in np.flatnonzero(several):
        if seen[s]:
            continue
        group, edge = [], np.array([s])
        seen[s] = True
        while len(edge):
            group.append(edge)
            reached = np.unpackbits(np.bitwise_or.reduce(links[edge], axis=0).view(np.uint8), bitorder="little")[:len(fps)].astype(bool)
            edge = np.flatnonzero(reached & ~seen)
            seen[edge] = True
        members = np.concatenate(group)
        members = members[members != s]
        left += fps[members].view(np.int64).tolist()
        right += [int(fps[s:s + 1].view(np.int64)[0])] * len(members)
    return left, right


def _links(batches: Iterator[pa.RecordBatch], radius: int, rows_at_once: int) -> Iterator[pa.RecordBatch]:
    """Compares the rows of a partition sorted by bucket; small buckets share a block, none is cut."""
    schema = pa.schema([("_u", pa.int64()), ("_v", pa.int64())])
    held: list[np.ndarray] = []
    held_rows, last = 0, None

    def flush() -> pa.RecordBatch:
        u, v = stars(np.concatenate(held), radius)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    for batch in batches:
        fp = batch.column("_fp").to_numpy().view(np.uint64)
        keys = np.stack([batch.column(c).to_numpy() for c in ("_k", "_part", "_a", "_b")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if len(fp) else []
        for i, at in enumerate(starts):
            end = starts[i + 1] if i + 1 < len(starts) else len(fp)
            key = tuple(keys[:, at])
            if held_rows >= rows_at_once and key != last:
                yield flush()
                held, held_rows = [], 0
            held.append(fp[at:end])
            held_rows += end - at
            last = key
    if held_rows:
        yield flush()


def link_fingerprints(fps: DataFrame, max_bits: int = 2, tile: int = TILE) -> DataFrame:
    """(_u, _v): links that connect all distinct fingerprints within `max_bits` of each other.

    With the bits cut into max_bits + 2 blocks, close fingerprints agree in two blocks at least, so
    each pair of blocks is a bucket key. Buckets of more than `tile` members are cut into tiles, and
    every pair of tiles is one block of work, so no task holds a bucket whole.
    """
    blocks = max_bits + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for k in pair for b in range(edges[k], edges[k + 1])) for pair in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("_fp").distinct().select("_fp", F.posexplode(F.array(*[F.col("_fp").bitwiseAND(F.lit(m)) for m in signed]))
                                                ).toDF("_fp", "_part", "_k")
    sizes = keyed.groupBy("_k", "_part").agg(F.count("*").alias("_n")).filter("_n > 1")
    tiles = F.ceil(F.col("_n") / tile).cast("int")
    own = F.pmod(F.xxhash64("_fp"), F.col("_tiles")).cast("int")
    spread = (keyed.join(sizes, ["_k", "_part"]).withColumn("_tiles", tiles).withColumn("_own", own)
              .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
              .select("_fp", "_k", "_part", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b")))
    sorted_rows = spread.repartition("_k", "_part", "_a", "_b").sortWithinPartitions("_k", "_part", "_a", "_b")
    return sorted_rows.mapInArrow(partial(_links, radius=max_bits, rows_at_once=1024), "_u long, _v long").distinct()


def connected(links: DataFrame, u: str = "_u", v: str = "_v") -> DataFrame:
    """(_node, _root): the smallest node reachable, for every node that has a link.

    Alternating large and small stars; each round is written to the shared folder, and the rounds
    end when the links no longer change.
    """
    now = written(links.select(F.greatest(u, v).alias("_u"), F.least(u, v).alias("_v")).filter("_u <> _v").distinct(), "links")
    mark = None
    while True:
        both = now.union(now.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.min("_v").alias("_m"))
        large = (both.join(least, "_u").filter("_v > _u")
                 .select(F.col("_v").alias("_u"), F.least("_m", "_u").alias("_v")).distinct())
        low = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(low, "_u").select(F.inline(F.array(
            F.struct(F.col("_v").alias("_u"), F.col("_m").alias("_v")), F.struct(F.col("_u"), F.col("_m").alias("_v")))))
        now = written(small.filter("_u <> _v").distinct(), "links")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            return now.groupBy("_u").agg(F.min("_v").alias("_root")).select(F.col("_u").alias("_node"), "_root").unionByName(
                now.select(F.col("_v").alias("_node"), F.col("_v").alias("_root")).distinct())
        mark = (row["n"], row["h"])


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row; the component is the smallest id reachable.

    Fingerprints link at `max_bits` or fewer differing bits. Rows of equal fingerprint collapse to
    one before any comparison, so copies never meet in pairs, and no link is lost. Null and empty
    texts have fingerprint zero and link like any other; ids that are null are never a component's
    name unless all its ids are; repeated rows keep a row each; an empty table gives no rows.
    """
    rows = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    groups = rows.groupBy("_fp").agg(F.min("_id").alias("_least"))
    roots = connected(link_fingerprints(groups, max_bits))
    named = groups.join(roots, F.col("_fp") == F.col("_node"), "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    members = named.join(least, "_root").select("_fp", "_component")
    return rows.join(members, "_fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.col("_component").alias("component_id"))
