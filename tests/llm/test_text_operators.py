"""Operators on texts, against plain Python on the smallest tables and on odd texts."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.samples import ODD, SF
from strataframe.llm.bpe import WordBpe, decode_bpe, encode_bpe, load
from strataframe.llm.common import id_bucket
from strataframe.llm.langid import fit_dictionaries, identify_language
from strataframe.llm.pii import KINDS, detect_pii, luhn, mod97, redact_pii
from strataframe.llm.quality import fit_rules, score_quality, tree_paths
from strataframe.llm.queries import BYTE_BPE, QUERIES, WORD_BPE
from strataframe.llm.tokenfile import from_planes, read_token_file, to_planes, write_token_file
from strataframe.session import scratch_path

LIBRARY = Tokenizer.from_file(WORD_BPE)
TEXTS = st.lists(st.sampled_from([*"abt eénΣ'\n 1!", "the", "ing", "<|endoftext|>", "ß", "İ"]), max_size=60).map("".join)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("source", ["docs", "odd"])
def test_bpe_agrees_with_the_library(request, source):
    df = request.getfixturevalue(source)
    library = Tokenizer.from_file(WORD_BPE)
    expected = []
    for row in df.select("doc_id", "text").collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        expected.append((row["doc_id"], ids, library.decode(ids, skip_special_tokens=False)))
    assert by_id(decode_bpe(encode_bpe(df, WORD_BPE), WORD_BPE)) == sorted(expected, key=repr)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_bpe_of_any_text(text):
    ids = np.frombuffer(load(WORD_BPE).encode_batch([text])[0], "<i4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("context", ["a%sb", "%s", "e%s"])
def test_bpe_of_every_code_point(context):
    # Planes 3 and up hold few characters; beyond the assigned ones a sample of them is enough.
    points = [*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 61), *range(0x2A6D0, 0x2A710), *range(0xE0100, 0xE01F0)]
    bpe = load(WORD_BPE)
    for at in range(0, len(points), 20_000):
        cases = [context % chr(c) for c in points[at:at + 20_000]]
        expected = [e.ids for e in LIBRARY.encode_batch(cases, add_special_tokens=False)]
        assert [np.frombuffer(x, "<i4").tolist() for x in bpe.encode_batch(cases)] == expected


def test_bpe_makes_room(monkeypatch):
    text = ["one two thr\u0899ee four", "two five six seven", "one " * 5 + "eight nine \U0001fae0 ten"]
    expected = [LIBRARY.encode(t, add_special_tokens=False).ids for t in text]
    for words, characters, at_once in ((300, 10, 2), (3, 1000, 1), (10, 30, 3)):
        for name, value in zip(("REMEMBERED", "CHARACTERS", "AT_ONCE"), (words, characters, at_once)):
            monkeypatch.setattr(f"strataframe.llm.bpe.{name}", value)
        bpe = WordBpe(WORD_BPE)
        for _ in range(2):
            assert [np.frombuffer(x, "<i4").tolist() for x in bpe.encode_batch(text)] == expected


@given(st.lists(st.text("etaoinshrdlu", min_size=1, max_size=30), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_speculation_changes_nothing(words):
    bpe = load(WORD_BPE)
    assert bpe.encode_words(words) == [bpe.merge(w) for w in words]
    for w in words:
        parts = [bpe.number[c] for c in [*w[:-1], w[-1] + bpe.end]]
        assert bpe._merge_long(list(parts)) == bpe._merge_short(list(parts))


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (encode_bpe(none, WORD_BPE), detect_pii(none), redact_pii(none), identify_language(none, {}),
               score_quality(none, fit_rules(none, labels, F.lit(True)))):
        assert df.count() == 0
    path = scratch_path(spark, "none")
    write_token_file(none, path, BYTE_BPE, 2)
    assert read_token_file(spark, path).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p[-6:]) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


@pytest.mark.parametrize("source", ["docs", "odd"])
def test_base_spans(request, source):
    df = request.getfixturevalue(source)
    found = detect_pii(df)
    assert found.columns == ["doc_id", "spans"]
    got = [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in BASE]) for r in found.collect()]
    expected = [(r["doc_id"], base_spans(r["text"])) for r in df.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@given(st.text("ab@.-+1234567890 ()", max_size=80))
@settings(max_examples=500, deadline=None)
def test_base_spans_of_any_text(text):
    from strataframe.llm.pii import find_spans

    assert [(s["kind"], s["start"], s["end"]) for s in find_spans(text) if s["kind"] in BASE] == base_spans(text)


def test_added_spans_and_redaction(odd):
    spans = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in detect_pii(odd).collect()}
    assert ("iban", 1.0) in spans[ODD.index(next(t for t in ODD if t and t.startswith("iban")))]
    ssn = [s for s in spans[ODD.index(next(t for t in ODD if t and t.startswith("ssn")))] if s[0] == "ssn"]
    assert ssn == [] or all(score >= 0.5 for _, score in ssn)
    clean = {r["doc_id"]: r["text"] for r in redact_pii(odd).collect()}
    assert clean[0] is None and clean[1] == ""
    assert clean[16].startswith("mail me at [EMAIL], or a@b or @x.y or c@@d.ef")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")
    assert redact_pii(odd).columns == odd.columns


def test_query_of_spans(spark):
    for r in QUERIES["op8_pii"](spark, SF).collect():
        base = [s for s in r["spans"].split(",") if s and s.split(":")[0] in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS[:4]] == [sum(s.startswith(k + ":") for s in base) for k in KINDS[:4]]


def test_language(docs, odd):
    learned = fit_dictionaries(docs, id_bucket("_id", 3) != 1)
    assert sorted(learned) == ["de", "en", "es", "fr"]
    held = identify_language(docs.filter(id_bucket("doc_id", 3) == 1).filter("n_chars > 100"), learned).toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert held["score"].between(0, 1).all()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(odd, learned).collect()}
    assert got[0] == got[1] == got[ODD.index("12 " * 400)] == ("und", 0.0)
    assert got[5][0] in learned
    assert {r["lang_pred"] for r in identify_language(docs, {}).collect()} == {"und"}
    assert fit_dictionaries(docs.filter("doc_id < 0"), F.lit(True)) == {}


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_rules(docs, labels, id_bucket("_id", 5) != 0)
    assert 0 < len(model.rules)
    seen = score_quality(docs, model).join(labels, "doc_id").toPandas()
    assert ((seen["score"] >= 0.3).astype(int) == seen["predicted"]).all()
    assert (seen["predicted"] == seen["quality"]).mean() > 0.9
    scores = score_quality(odd, model).toPandas()
    assert len(scores) == len(ODD) + 2 and scores["score"].between(0, 1).all()
    assert scores["score"][0] == scores["score"][1]
    same = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert score_quality(docs, fit_rules(docs, same, F.lit(True))).filter("predicted = 1").count() == docs.count()
    assert tree_paths("  If (feature 0 <= 1.5)\n   Predict: 0.0\n  Else (feature 0 > 1.5)\n   If (feature 1 <= 2.0)\n") == {
        "_q_chars <= 1.5D", "_q_chars > 1.5D", "_q_chars > 1.5D AND _q_words <= 2.0D"}


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["bit", "byte"]), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_planes_round_trip(ids, kind, block):
    ids = np.array(ids, np.uint32)
    assert from_planes(to_planes(ids, kind, block), len(ids), kind, block).tolist() == ids.tolist()


@pytest.mark.parametrize("source,kind", [("docs", "byte"), ("odd", "byte"), ("odd", "bit")])
def test_token_file(request, spark, source, kind):
    df, library = request.getfixturevalue(source), Tokenizer.from_file(BYTE_BPE)
    path = scratch_path(spark, "file")
    write_token_file(df, path, BYTE_BPE, 2, kind=kind, block=1000, chunk=5000)
    got = read_token_file(spark, path).orderBy("start").collect()
    rows = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["h"]) if r["doc_id"] is not None else (False, 0, 0))
    at = 0
    for row, g in zip(rows, got, strict=True):
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids + [2]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (row["doc_id"], at, len(ids))
        assert np.frombuffer(g["ids"], "<u4").tolist() == ids
        at += len(ids)
    if source == "docs":
        query = {r["doc_id"]: r for r in QUERIES["op9_tokenfile"](spark, SF).collect()}
        assert all(query[g["doc_id"]]["ids_crc32"] == zlib.crc32(g["ids"]) and query[g["doc_id"]]["start"] == g["start"] for g in got)
    with pytest.raises(ValueError):
        write_token_file(df, path, BYTE_BPE, 2, kind="nibble")
