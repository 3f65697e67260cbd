"""Token ids on disk: blocks of ids turned into bit or byte planes, each plane compressed, behind a chunk index.

A token file is a Parquet folder without Parquet's own compression. A row is a chunk of whole
documents; its index columns (part, chunk, first, n_ids, doc_ids, lengths) can be read without its planes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import ship, texts
from strataframe.llm.tokens import load

BLOCK = 1 << 14
CHUNK = 1 << 16
SCHEMA = ("part int, chunk int, first long, n_ids long, doc_ids array<long>, lengths array<long>, "
          "block int, kind string, planes array<binary>")
_ARROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("block", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary()))])


def to_planes(ids: np.ndarray, kind: str, block: int, level: int = 3) -> list[bytes]:
    """Plane p of every block in turn, compressed; the last block may be short. Empty planes stay tiny."""
    packer = zstandard.ZstdCompressor(level=level)
    n_planes = 4 if kind == "byte" else 32
    planes: list[list[bytes]] = [[] for _ in range(n_planes)]
    for i in range(0, len(ids), block):
        parts = np.ascontiguousarray(ids[i:i + block].astype("<u4")).view(np.uint8).reshape(-1, 4)
        if kind == "bit":
            parts = np.packbits(np.unpackbits(parts, axis=1, bitorder="little"), axis=0, bitorder="little")
        for p in range(n_planes):
            planes[p].append(parts[:, p].tobytes())
    return [packer.compress(b"".join(p)) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str, block: int) -> np.ndarray:
    """The ids that `to_planes` was given."""
    unpacker = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpacker.decompress(p), np.uint8) for p in planes]
    out, at = np.empty(n, np.uint32), 0
    for i in range(0, n, block):
        size = min(block, n - i)
        width = size if kind == "byte" else -(-size // 8)
        parts = np.stack([r[at:at + width] for r in raw], axis=1)
        if kind == "bit":
            parts = np.packbits(np.unpackbits(parts, axis=0, bitorder="little", count=size), axis=1, bitorder="little")
        out[i:i + size] = np.ascontiguousarray(parts).view("<u4").ravel()
        at += width
    return out


def _chunks(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, kind: str, block: int, chunk: int) -> Iterator[pa.RecordBatch]:
    bpe, part = load(tokenizer), TaskContext.get().partitionId()
    number, first = 0, 0
    docs: list[int | None] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        planes = to_planes(np.concatenate(held), kind, block)
        row = [part, number, first, size, docs, [len(h) for h in held], block, kind, planes]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

    for batch in batches:
        for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
            ids = np.append(bpe.encode(text.as_py()), np.uint32(end_id))
            docs.append(doc)
            held.append(ids)
            size += len(ids)
            if size >= chunk:
                yield flush()
                number, first, docs, held, size = number + 1, first + size, [], [], 0
    if held:
        yield flush()


def write_token_file(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                     kind: str = "byte", block: int = BLOCK, chunk: int = CHUNK) -> None:
    """Writes the ids of all rows in ascending order of an integer id, each followed by `end_id`.

    `kind` is byte (4 planes) or bit (32 planes). Rows are dealt by ranges of (id, text hash), so
    that repeated ids do not meet in one task, and part numbers follow the order. Null ids come
    first; null text is empty, which leaves the end id alone. A document is never cut over chunks.
    An empty table writes a file without chunks.
    """
    if kind not in ("byte", "bit"):
        raise ValueError(f"planes are of kind byte or bit, not {kind!r}")
    rows = texts(df, id_col, text_col).withColumn("_id", F.col("_id").cast("long")).withColumn("_hash", F.xxhash64("_text"))
    dealt = rows.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash").select("_id", "_text")
    run = partial(_chunks, tokenizer=tokenizer, end_id=end_id, kind=kind, block=block, chunk=chunk)
    dealt.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids"]
    for batch in batches:
        for row in batch.to_pylist():
            ids = from_planes(row["planes"], row["n_ids"], row["kind"], row["block"])
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + row["offset"] + starts, pa.int64()),
                pa.array(row["lengths"], pa.int64()),
                pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)], pa.binary())], names=names)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token file.

    `start` counts the ids of all documents before it; `ids` holds little-endian unsigned integers
    of four bytes. The totals of the parts, one row for each task that wrote, are added up on the driver.
    """
    ship(spark)
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    offsets, at = [], 0
    for part, n in sorted(totals):
        offsets.append((part, at))
        at += n
    parts = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    return rows.join(parts, "part").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")
