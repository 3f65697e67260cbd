"""Stages on odd tables, registered queries against plain versions, and what must stop or survive."""

import hashlib
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from llm.samples import ODD, SF
from strataframe.llm import packing, tokens
from strataframe.llm.common import id_bucket
from strataframe.llm.langid import fit_dictionaries, identify_language
from strataframe.llm.lmscore import score_documents
from strataframe.llm.packing import B, K1, Shard
from strataframe.llm.quality import fit_rules, score_quality
from strataframe.llm.queries import ASKED, BYTE_BPE, QUERIES, WORD_BPE
from strataframe.llm.tokens import ByteBpe, load
from strataframe.llm.topk import exact_top_k

CLASH = ("score", "predicted", "lang_pred", "accepted", "_spans", "_redacted", "_q_text", "_q_chars", "_id", "_text", "_doc", "_key", "_fp", "spans")


@pytest.fixture(scope="module")
def clashing(docs, spark):
    odd = spark.createDataFrame([(900 + i, t, None, None, 0) for i, t in enumerate(ODD)] + [(900, "another text under that id, written by hand", None, None, 0)] * 2,
                                "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(odd).selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(CLASH)])


@pytest.mark.parametrize("name,stage", pipe.STAGES)
def test_stages_on_odd_and_empty_tables(spark, clashing, name, stage):
    got = stage(spark, clashing, SF)
    rows = got.collect()
    assert rows and stage(spark, clashing.limit(0), SF).count() == 0
    if name != "packing":
        assert got.columns == clashing.columns
        # What came in under those names goes out again.
        assert all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in rows)


def test_two_texts_under_one_id_both_stay(spark):
    rows = [(1, "one two three four five"), (1, "six seven eight nine ten"), (2, "six seven eight nine ten"), (1, "six seven eight nine ten")]
    kept = pipe.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[1]]


def test_scores_do_not_depend_on_the_partitions(spark, docs):
    train = id_bucket("_id", 5) != 1
    plain = {r["doc_id"]: tuple(r)[1:] for r in score_documents(docs, train, across=True).collect()}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        dealt = {r["doc_id"]: tuple(r)[1:] for r in score_documents(docs.repartition(16, "doc_id"), train, across=True).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(dealt) == docs.count() and dealt.keys() == plain.keys()
    for i, row in plain.items():
        assert dealt[i] == pytest.approx(row, rel=1e-9)


@pytest.mark.parametrize("large", [1e12, 1e300])
def test_products_beyond_64_bits_stop_the_job(spark, large):
    df = spark.createDataFrame([(0, [1.0, large]), (1, [2.0, large]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        exact_top_k(df, ASKED).collect()


def test_dictionaries_learn_from_whole_texts(spark):
    late = "".join(f"{w} " for w in ["1234567890"] * 600) + "schließlich kommt das deutsche Wort am Ende " * 8
    rows = [(None, late, "de"), (None, late, "de"), (1, "the english words stand here at once and again", "en")]
    learned = fit_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sorted(learned) == ["de", "en"] and "schließlich".encode() in learned["de"]
    named = identify_language(spark.createDataFrame([("das deutsche Wort kommt",), ("english words stand here",)], "text string"), learned)
    assert [r["lang_pred"] for r in named.collect()] == ["de", "en"]


def test_held_out_language_and_quality(spark, docs):
    got = QUERIES["op5_langid"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got["held_out"] & (got["lang_pred"] != "und")]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").toPandas()
    got = QUERIES["op10_quality"](spark, SF).toPandas().merge(labels, on="doc_id", how="left")
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got["held_out"] & got["quality"].notna()]
    assert len(held) and (held["predicted"] == held["quality"]).mean() > 0.9


def test_registered_encodings(spark, docs):
    library = Tokenizer.from_file(WORD_BPE)
    got = {r["doc_id"]: r for r in QUERIES["op3_bpe"](spark, SF).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_registered_packing(spark, docs):
    library, pieces, sequences = Tokenizer.from_file(BYTE_BPE), defaultdict(list), defaultdict(int)
    for r in QUERIES["op7_packing"](spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
    for r in docs.collect():
        ids, at = np.array(library.encode(r["text"], add_special_tokens=False).ids + [1], "<u4"), 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_shard_scores_are_bm25():
    rng = np.random.default_rng(8)
    ids = [rng.zipf(1.3, rng.integers(1, 60)) % 300 for _ in range(120)]
    idf, mean = rng.random(300) + 0.1, 30.0
    shard = Shard([np.asarray(x) for x in ids], idf, mean)
    assert 0 < len(shard.dense) < len(shard.terms)
    for seed in (0, 7, 63):
        expected = [sum(idf[t] * (n := (x == t).sum()) * (K1 + 1) / (n + K1 * (1 - B + B * len(x) / mean)) for t in set(ids[seed].tolist()) if (x == t).any())
                    for x in ids]
        assert shard.scores(seed) == pytest.approx(expected)


def test_quality_without_labels(spark, docs):
    none = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    scored = score_quality(docs, fit_rules(docs, none, F.lit(True)))
    assert {r["score"] for r in scored.select("score").distinct().collect()} == {0.5}


def test_windows_take_neighbours_in_order():
    """The best unused neighbour that fits comes next; what is best of the rest is cut."""
    rng = np.random.default_rng(9)
    ids = [rng.zipf(1.3, rng.integers(1, 60)) % 300 for _ in range(150)]
    idf, window = rng.random(300) + 0.1, 64
    found = list(Shard(ids, idf, 30.0).windows(window))
    scores, left, expected = Shard(ids, idf, 30.0), [len(x) for x in ids], []
    while any(left):
        seed = next(i for i, n in enumerate(left) if n)
        pieces, room = [], window

        def take(doc, n):
            nonlocal room
            pieces.append((doc, len(ids[doc]) - left[doc], n))
            left[doc] -= n
            room -= n

        take(seed, min(room, left[seed]))
        score = scores.scores(seed)
        order = [i for i in sorted(range(len(ids)), key=lambda i: -score[i]) if left[i] and score[i]]
        for i in order:
            if left[i] <= room:
                take(i, left[i])
        for i in [*order, *range(len(ids))]:
            if room and left[i]:
                take(i, min(room, left[i]))
        expected.append(pieces)
    assert found == expected


def test_ids_are_counted_while_they_are_made(spark, monkeypatch):
    """Document counts come with the pieces, so ids are not read and sorted again."""
    batch = pa.RecordBatch.from_pydict({"_id": [1, 2, 3], "_text": ["a b a", "", "a " * 3000]})
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    groups = SimpleNamespace(value=packing.Groups([], load(BYTE_BPE).vocabulary, 2))
    made = pa.Table.from_batches(packing._tokenised(iter([batch]), BYTE_BPE, 1, 2048, groups)).to_pylist()
    *pieces, last = made
    expected = defaultdict(int)
    for r in pieces:
        assert r["occurs"] is None
        for i in set(np.frombuffer(r["ids"], "<u4").tolist()) if r["sequence_id"] is None else ():
            expected[i] += 1
    assert last["_id"] is None and last["ids"] is None and expected[1] == 3
    assert {i: n for i, n in enumerate(np.frombuffer(last["occurs"], np.int64).tolist()) if n} == expected


def test_distinct_words_are_encoded_once(monkeypatch):
    """Documents are cut into words together; only new words meet the tokenizer, and no document does on its own."""
    met, words = [], ByteBpe._encode_words
    monkeypatch.setattr(ByteBpe, "_encode_words", lambda self, new: met.extend(new.to_pylist()) or words(self, new))
    texts = ["a blank, a word", "another word, a blank", "", "word"] * 50
    batch = pa.RecordBatch.from_pydict({"_id": list(range(len(texts))), "_text": texts})
    expected = [Tokenizer.from_file(BYTE_BPE).encode(t).ids + [1] for t in texts]
    load.cache_clear()
    load(BYTE_BPE)
    monkeypatch.setattr(ByteBpe, "encode", None)
    made = pa.Table.from_batches(packing._sampled(iter([batch, batch]), BYTE_BPE, 1, 2048))["ids"].to_pylist()
    assert [np.frombuffer(x, "<u4").tolist() for x in made] == expected * 2
    assert sorted(met) == sorted({b"a", b" a", b" blank", b",", b" word", b"another", b"word"})


@pytest.mark.parametrize("at_once,remembered", [(1 << 21, 300_000), (40, 12)])
def test_ids_of_many_texts(monkeypatch, at_once, remembered):
    monkeypatch.setattr(tokens, "AT_ONCE", at_once)
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    parts = ["'", "'s", "'ll", "'re", "'ve", "'d", "s", "l", "re", " ", "  ", "\t", "\n", "\u00a0", "\u3000", "\x85", "\x1c", "\u200b", "\u180e", "a", "Z", "é",
             "中", "1", "٣", "²", "Ⅷ", "!", "-", "\U0001f642", "\u0301", "\x00", "\U0001d4b3", "<|endoftext|>", "<|", "’", "ſ", "x" * 30]
    rng = np.random.default_rng(11)
    texts = ["", *["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)], *ODD, ""]
    texts = [t or "" for t in texts]
    load.cache_clear()
    made = list(load(BYTE_BPE).encode_many(iter(texts)))
    assert {x.dtype for x in made} == {np.dtype(np.uint32)}
    assert [x.tolist() for x in made] == [e.ids for e in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]
