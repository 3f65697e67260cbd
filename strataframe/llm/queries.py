"""The operators as registered queries, and the pipeline: thin calls on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.ann import approximate_neighbours
from strataframe.llm.bpe import decode_bpe, encode_bpe
from strataframe.llm.common import id_bucket, table
from strataframe.llm.divergence import source_divergence
from strataframe.llm.langid import fit_dictionaries, identify_language
from strataframe.llm.lmscore import score_documents
from strataframe.llm.packing import pack_documents
from strataframe.llm.pii import BASE_KINDS, KINDS, detect_pii
from strataframe.llm.quality import fit_rules, score_quality
from strataframe.llm.simhash import simhash_groups
from strataframe.llm.spelling import spelling_variants
from strataframe.llm.tokencount import count_tokens
from strataframe.llm.tokenfile import read_token_file, write_token_file
from strataframe.llm.topk import exact_top_k
from strataframe.session import scratch_path

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECE_BPE = str(public_tokenizers.path("piece_bpe_32k.model"))

ASKED = "_id % 50 = 0"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"), ASKED)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), ASKED)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_bpe(encode_bpe(table(spark, sf_dir, "documents"), WORD_BPE), WORD_BPE)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), id_bucket("_id", 5) != 1, across=True)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = fit_dictionaries(docs, id_bucket("_id", 3) != 1)
    named = identify_language(docs.select("doc_id", "text"), learned)
    return named.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_pii(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def joined(keep):
        # Spans come by kind as listed, then by start.
        return F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = joined(lambda s: F.array_position(kinds, s["kind"]) <= BASE_KINDS)

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in KINDS[:BASE_KINDS]], F.sha2(base, 256).alias("base_sha256"), joined(lambda s: F.lit(True)).alias("spans"))


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokenfile")
    write_token_file(table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=2)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_rules(docs, table(spark, sf_dir, "labels"), id_bucket("_id", 5) != 0)
    return score_quality(docs, model).select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT for k in range(8)]),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY ALL),
b AS (SELECT run, k, hex(encode(concat(doc_id, ':', run))) AS h FROM d WHERE length(run) >= 7),
s AS (SELECT run, k, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1]))) AS h FROM b, crc),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM s),
w AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
-- Words are one edit apart if one, or each at the same place, lacks one letter.
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.less
      UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.less),
q AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM p),
f AS (SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= 10 * w.n THEN q.near END AS form, CASE WHEN q.n >= 10 * w.n THEN q.n END AS form_n
      FROM w LEFT JOIN q ON q.word = w.word AND q.place = 1),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e USING (word)"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, term, source, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(DISTINCT doc) AS docs, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n, coalesce(o.n, 0) AS n
      FROM g LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL) o USING (lang, source)),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * s.v) AS p,
             1 + (1000000000::HUGEINT * (k.total + 5)) // (s.lang_n + 5 * s.v) AS q
      FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
            ON v.lang = a.lang AND v.source = a.source AND v.other = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ann, op2_topk, op3_bpe, op4_lm, op5_langid, op6_simhash, op7_packing, op8_pii, op9_tokenfile, op10_quality,
    op11_tokencount, op12_spelling, op13_divergence, pipeline)}
ORACLE: dict[str, str] = {"op2_topk": TOPK_SQL, "op12_spelling": SPELLING_SQL, "op13_divergence": DIVERGENCE_SQL}
