"""Token counts, spelling variants and source divergence, against the library, SQL and plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.samples import SF
from strataframe.llm.divergence import Forest, shares, source_divergence
from strataframe.llm.queries import ORACLE, PIECE_BPE, QUERIES
from strataframe.llm.spelling import Router, Words, letter_counts, near_words, one_edit, spelling_variants
from strataframe.llm.tokencount import Transducer, count_tokens, load

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def by_sql(name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    return names, sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("source", ["docs", "odd", "none"])
def test_token_counts(request, source):
    df = request.getfixturevalue(source)
    expected = [(r["doc_id"], len((r["text"] or "").encode()), len(LIBRARY.encode(r["text"] or ""))) for r in df.select("doc_id", "text").collect()]
    assert rows(count_tokens(df, PIECE_BPE), "doc_id", "n_bytes", "n_tokens") == sorted(expected, key=repr)


def test_query_of_token_counts(spark, docs):
    expected = [(r["doc_id"], len(r["text"].encode()), n := len(LIBRARY.encode(r["text"])), n > 4096) for r in docs.collect()]
    got = QUERIES["op11_tokencount"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert rows(got) == sorted(expected, key=repr)


@given(st.text() | st.lists(st.sampled_from([*"abthein  ▁\n1é✓", "ing", "<s>", "<0x41>"]), max_size=600).map("".join))
@settings(max_examples=300, deadline=None)
def test_token_counts_of_any_text(text):
    assert load(PIECE_BPE).counts([text, "", text]) == [len(LIBRARY.encode(text)), 0, len(LIBRARY.encode(text))]


def test_chunks_without_a_fresh_start_and_forgetting():
    model = load(PIECE_BPE)
    # Chunks of 16 within words of thousands of letters must ask each other for their states; 50 states are soon too many.
    small = Transducer(model.scores, chunk=16, most_states=50)
    texts = ["ab" * 3000 + " " + "th" * 2000, "q" * 5000, " " * 4000, "the quick brown fox " * 90, "日本" * 900, "1" * 777]
    for _ in range(2):
        assert small.counts(texts) == [len(LIBRARY.encode(t)) for t in texts]
    with pytest.raises(ValueError):
        Transducer({"a": 0.0, "▁": -1.0, "a▁": -2.0})


def test_every_code_point_counts():
    model, points = load(PIECE_BPE), [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [f"a{c}e {c}" for c in points[at:at + 20_000]]
        assert model.counts(texts) == [len(p) for p in LIBRARY.encode(texts)]


@pytest.mark.parametrize("name", ["op12_spelling", "op13_divergence"])
def test_queries_agree_with_sql(spark, name):
    names, expected = by_sql(name, SF)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got, *names) == expected and expected


def plain_words(docs, shortest=7, least=2):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(docs):
    words = plain_words(docs)
    near = {w: [o for o in words if distance_one(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(out, key=repr)


VARIANTS = [("straßenbahn " * 3 + "strassenbahn " * 40 + "strasenbahn " * 2, 1), ("Zürich Zürichs zürichs×÷ " * 2, 2), ("abcdefgh " * 400 + "abcdefgx " * 40 + "abcdefxx " * 4, 7),
            ("listens silents enlists " * 3, 4), (("k" * 70 + " ") * 30 + ("k" * 69 + " ") * 2 + ("k" * 63 + " ") * 3 + ("k" * 64 + " ") * 50, 5), ("naïveté́s naïvetés " * 3, None)]
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("leaf", [20_000, 5])
def test_variants_by_brute_force(spark, odd, none, leaf):
    df = spark.createDataFrame([(t, i) for t, i in VARIANTS], "text string, doc_id long").selectExpr("*", "1 AS _word", "2 AS word", "3 AS _n")
    for frame in (df, odd, df.union(df), none):
        docs = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        got = rows(spelling_variants(frame, leaf_words=leaf, sample_per_leaf=4), *COLUMNS)
        assert got == plain_variants(docs)
    assert ("abcdefxx", "abcdefgx", "abcdefgh", 4, 1, 40) in plain_variants([(i, t) for t, i in VARIANTS])
    with pytest.raises(ValueError):
        spelling_variants(df, ratio=1)


def test_crowded_leaves_lose_no_word(spark):
    # Anagrams have equal counts, so no tree can part them.
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.permutation(list("abcdefgh"))) for _ in range(300)} | {"abcdefgh", "abcdefgx", "abcdefg"})
    df = spark.createDataFrame([(1, " ".join(words * 2))], "doc_id long, text string")
    assert rows(spelling_variants(df, leaf_words=20, sample_per_leaf=2), *COLUMNS) == plain_variants([(1, " ".join(words * 2))])


@given(st.lists(st.text("abcé", min_size=1, max_size=6), min_size=1, max_size=60, unique=True))
@settings(max_examples=100, deadline=None)
def test_near_words_of_any_words(words):
    words = [w.encode("latin-1") for w in words]
    i, j = near_words(words, Words(words))
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(len(words)) for b in range(len(words)) if distance_one(words[a], words[b])]
    assert all(one_edit(a, b) == distance_one(a, b) for a in words for b in words)


def test_boxes_within_reach():
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"abcdefgh"), 9).tolist()) for _ in range(400)]
    points = letter_counts(words)
    router = Router(points, 16)
    home = {int(p): leaf for leaf, own in router.reach(points, 0) for p in own}
    assert len(home) == 400 and len(set(home.values())) == router.leaves > 8
    for radius in (1, 2):
        reached = {(int(p), leaf) for leaf, own in router.reach(points, radius) for p in own}
        close = np.abs(points[:, None] - points[None]).sum(axis=2) <= radius
        assert all((int(a), home[int(b)]) in reached for a, b in zip(*np.nonzero(close)))
        assert len(reached) < 400 * router.leaves


def plain_divergence(docs, min_docs, best):
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = ["".join(c.lower() if c.isascii() else c for c in t) for t in found]
        count[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = []
    for lang in {k[0] for k in count}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        groups = {k[1]: c for k, c in count.items() if k[0] == lang}
        whole = sum(groups.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept} for s, c in {**groups, None: whole}.items()}
        for s in groups:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            over = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(over[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(16_384, 64), (5, 2)])
def test_divergence_by_brute_force(spark, docs, odd, none, sizes):
    made = [("en", f"s{k % 5}", f"alpha beta gamma{k % 3} Ωmega x y-z {'delta ' * (k % 4)}") for k in range(40)] + [(None, None, None), ("xx", "one", "alone"), ("xx", "two", ""), ("en", None, "alpha alpha")]
    df = spark.createDataFrame(made, "lang string, source string, text string").selectExpr("*", "1 AS _lang", "2 AS _term", "3 AS value", "4 AS rank")
    for frame, least in ((df, 3), (df.union(df), 7), (odd, 2), (none, 1), (docs.limit(60), 4)):
        plain = [(r["lang"], r["source"], r["text"]) for r in frame.select("lang", "source", "text").collect()]
        got = source_divergence(frame, min_docs=least, best_terms=4, block_terms=sizes[0], tile_sources=sizes[1])
        assert rows(got, "lang", "source", "part", "item", "value", "rank") == plain_divergence(plain, least, 4)


def test_equal_subtrees_are_one_node():
    counts = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0], [1, 2, 1, 2, 0, 0, 0, 0]])
    forest = Forest(counts)
    assert len(forest.leaf_counts) == 3 and len(forest.children[0]) == 2 and forest.roots[0] == forest.roots[2]
    priced = []

    def price(pair, a, b):
        priced.append(len(pair))
        return np.abs(a - b)

    assert forest.walk(np.array([0, 0]), np.array([1, 2]), price).tolist() == [int(np.abs(counts[0] - counts[1]).sum()), 0]
    # Eight leaves a pair, of which only the different pairs of counts are priced.
    assert priced == [7 + 3]
    huge = np.array([10**17, 3])
    assert shares(huge, 10**17 + 13).tolist() == [1 + 10**9 * (10**17 + 5) // (10**17 + 13), 1 + 10**9 * 8 // (10**17 + 13)]
