"""From raw documents to packed sequences: quality, language, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a
frame that `run` writes as Parquet and reads again. All but the last return the columns of documents,
with the values that came in; columns of any other name pass through. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import id_bucket, table, written
from strataframe.llm.langid import fit_dictionaries, identify_language
from strataframe.llm.packing import pack_documents
from strataframe.llm.pii import redact_pii
from strataframe.llm.quality import fit_rules, score_quality
from strataframe.llm.queries import BYTE_BPE
from strataframe.llm.simhash import simhash_groups


def boxed(docs: DataFrame) -> DataFrame:
    """(text, _doc): the other columns lie inside one, so that no name of an operator can clash with theirs."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"))


def unboxed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble scores below 0.3.

    Null texts are scored as empty ones; repeated rows alike; very long texts whole; without labels
    every document scores 0.5 and stays.
    """
    model = fit_rules(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), id_bucket("_id", 5) != 0)
    return unboxed(score_quality(boxed(docs), model).filter("predicted = 1"), docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose two best languages compress them almost alike.

    Null and empty texts have no letters; repeated rows go or stay together; texts of any length are
    read whole; where no document names its language, none is learned and all go.
    """
    learned = fit_dictionaries(docs, id_bucket("_id", 3) != 1)
    return unboxed(identify_language(boxed(docs), learned).filter("accepted"), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id; of repeated rows of it, one.

    Different texts under one id are documents of their own. Documents without an id cannot be told
    apart by it and all stay. Null and empty texts are near copies of each other.
    """
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64(F.col("text").isNull(), "text").alias("h"))
    named = docs.filter("doc_id IS NOT NULL").select(key.alias("_key"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"))
    groups = simhash_groups(named.select("_key", "text"), id_col="_key", shingle=3, max_bits=2)
    first = groups.filter("_key = component_id").select("_key").distinct()
    kept = named.join(first, "_key", "left_semi").dropDuplicates(["_key"])
    return unboxed(kept, docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars, where there is one, follows the new text.

    Null and empty texts stay as they are; no document goes, repeated ones included.
    """
    clean = unboxed(redact_pii(boxed(docs)), docs.columns)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens at most, with the checksum of each piece's ids.

    Null and empty texts are the end id alone; repeated rows are packed one by one; long documents are cut.
    """
    packed = pack_documents(docs, BYTE_BPE, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packing)]

#: No stage can be said in SQL: trained rules, compression, hashes of shingles, checksums and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
