"""Language by compression: each language's sample text is a zstandard dictionary, the smallest result wins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import ship

UNKNOWN = "und"
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# Narrow margins are looked at again with a more thorough search.
_SECOND_LEVEL = 9


def _letters(text: str) -> bytes:
    """Lower-case words of letters with one space around each; what is not a letter says nothing here."""
    words = _WORDS.findall(text.lower())
    return f" {' '.join(words)} ".encode() if words else b""


def spread_out(text: Column, size: int, parts: int = 8) -> Column:
    """At most `size` characters of a text: all, or pieces from all over it, the first and the last included."""
    piece = size // parts
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(
        text, (F.floor(i * (F.char_length(text) - piece) / (parts - 1)) + 1).cast("int"), F.lit(piece)))
    return F.when(F.char_length(text) <= size, text).otherwise(F.array_join(pieces, " "))


def fit_dictionaries(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     docs_per_lang: int = 64, bytes_per_doc: int = 2048, total_bytes: int = 16 << 20) -> dict[str, bytes]:
    """A raw-content dictionary per language, from a bounded sample of the rows where `train` holds.

    The sample is the `docs_per_lang` different rows of each language whose hashes of id and text are
    smallest, of each at most `bytes_per_doc` characters, taken from all over the text; all dictionaries
    together hold `total_bytes` at most. Rows without text or language teach nothing, rows without an id
    like any other, repeated rows once; a table without rows gives no dictionaries.
    """
    named = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("_lang"),
                      F.col(f"`{text_col}`").alias("_text")).filter(train & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    keyed = named.select("_lang", F.xxhash64("_id", "_text").alias("_k"), "_text")
    # Equal rows are one before they are ranked; only keys are shuffled.
    keys = keyed.select("_lang", "_k").withColumn("_n", F.dense_rank().over(Window.partitionBy("_lang").orderBy("_k"))).filter(F.col("_n") <= docs_per_lang)
    picked = keys.select("_lang", "_k").distinct()
    sample = (keyed.join(F.broadcast(picked), ["_lang", "_k"], "left_semi").select("_lang", "_k", spread_out(F.col("_text"), bytes_per_doc).alias("_text"))
              .groupBy("_lang", "_k").agg(F.min("_text").alias("_text")).orderBy("_lang", "_k").collect())
    parts: dict[str, list[bytes]] = {}
    for row in sample:
        parts.setdefault(row["_lang"], []).append(_letters(row["_text"]))
    share = total_bytes // max(1, len(parts))
    return {lang: b"\n".join(p)[:share] for lang, p in sorted(parts.items())}


@lru_cache(maxsize=4)
def _compressors(level: int, dictionaries: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def _sizes(data: bytes, compressors: list, chunk: int) -> list[int]:
    pieces = [data[i:i + chunk] for i in range(0, len(data), chunk)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def classify(text: str | None, names: list[str], compressors: list[list], chunk: int, scale: float) -> tuple[str, float]:
    """(language, score): the whole text in pieces, each compressed beside every dictionary."""
    data = _letters(text) if text else b""
    if not data or not names:
        return UNKNOWN, 0.0
    if len(names) == 1:
        return names[0], 1.0
    sizes = _sizes(data, compressors[0], chunk)
    for more in compressors[1:]:
        first, second = sorted(sizes)[:2]
        if second - first < scale / 4 * second:
            sizes = [a + b for a, b in zip(sizes, _sizes(data, more, chunk))]
    first, second = sorted(range(len(names)), key=lambda i: (sizes[i], names[i]))[:2]
    return names[first], 1.0 - math.exp((sizes[first] - sizes[second]) / sizes[second] / scale)


def _batches(batches: Iterator[pa.RecordBatch], text: str, dictionaries, level: int, chunk: int, scale: float) -> Iterator[pa.RecordBatch]:
    content = dictionaries.value
    names, made = [n for n, _ in content], [_compressors(x, content) for x in (level, _SECOND_LEVEL)]
    for batch in batches:
        found = [classify(t, names, made, chunk, scale) for t in batch.column(text).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=[*batch.schema.names, "lang_pred", "score"])


def identify_language(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_score: float = 0.05,
                      level: int = 5, chunk: int = 2048, scale: float = 0.05) -> DataFrame:
    """`df` with lang_pred, score (0 to 1, from the margin of the two best) and accepted (score >= min_score).

    Whole texts are compressed in pieces of `chunk` bytes, so that a long text cannot teach the
    compressor its own language. Narrow margins get a second, more thorough compression; ties go to
    the smaller name, with score 0. Texts that are null or have no letter are `und`, score 0; so is
    every text if no language was learned. Columns of those three names are replaced. One pass, no
    shuffle; the dictionaries are bounded by their fit.
    """
    ship(df.sparkSession)
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score", "accepted")])
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    run = partial(_batches, text=text_col, dictionaries=shared, level=level, chunk=chunk, scale=scale)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double").withColumn("accepted", F.col("score") >= min_score)
