"""Operators over whole corpora, against brute force on small tables."""

from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.samples import ODD, SF
from strataframe.llm.common import id_bucket
from strataframe.llm.lmscore import Trie, score_documents, tokens
from strataframe.llm.packing import Shard, pack_documents
from strataframe.llm.queries import ASKED, BYTE_BPE, ORACLE, QUERIES
from strataframe.llm.ann import CentroidGraph, approximate_neighbours, balanced_centroids, posting_lists
from strataframe.llm.simhash import connected, link_fingerprints, near, simhash_groups
from strataframe.llm.topk import exact_top_k


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, radius=2):
    """(fingerprint, smallest id reachable) of (id, fingerprint) by comparing everything."""
    least = {}
    for i, f in pairs:
        least[f] = i if least.get(f) is None else least[f] if i is None else min(i, least[f])
    names, seen, out = list(least), set(), {}
    for s in names:
        if s in seen:
            continue
        group, edge = [], [s]
        seen.add(s)
        while edge:
            group.append(edge.pop())
            for o in names:
                if o not in seen and (group[-1] ^ o).bit_count() <= radius:
                    seen.add(o)
                    edge.append(o)
        ids = [least[g] for g in group if least[g] is not None]
        for g in group:
            out[g] = min(ids, default=None)
    return out


@pytest.mark.parametrize("source", ["docs", "odd", "none"])
def test_simhash_groups(request, source):
    df = request.getfixturevalue(source)
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    expected = components(rows)
    got = [tuple(r) for r in simhash_groups(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, f"{f:016x}", expected[f]) for i, f in rows), key=repr)


def test_bit_sliced_comparison():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 40)], rng.integers(0, 2**63, 50, dtype=np.uint64)]))
    for radius in (0, 1, 2, 3, 5):
        bits = np.unpackbits(near(fps, radius).view(np.uint8), axis=1, bitorder="little")[:, :len(fps)]
        assert (bits == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_links_over_tiles_and_long_chains(spark):
    rng = np.random.default_rng(5)
    chain, x = [], 0
    for i in range(120):
        x ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
        chain.append(x)
    fps = sorted({*chain, *[int(v) for v in rng.integers(0, 2**63, 30)]})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "_fp long")
    expected = components([(s, f) for s, f in zip(signed, fps)])
    for tile in (4096, 3):
        roots = {r["_node"]: r["_root"] for r in connected(link_fingerprints(df, 2, tile)).collect()}
        assert {f: roots.get(s, s) for s, f in zip(signed, fps)} == expected


def plain_trie(words, order):
    """Counts of each context's symbols, as dictionaries."""
    table = defaultdict(Counter)
    for w, c in words.items():
        s = b" " + w + (b"" if w == b"\n" else b" ")
        for i in range(1, len(s)):
            for d in range(min(order, i) + 1):
                table[s[i - d:i]][s[i]] += c
    return table


def plain_log10(table, word, order):
    total, s = 0.0, b" " + word + (b"" if word == b"\n" else b" ")
    for i in range(1, len(s)):
        p, excluded, done = 1.0, set(), False
        for d in range(min(order, i), -1, -1):
            seen = table.get(s[i - d:i])
            if not seen:
                continue
            left = {k: v for k, v in seen.items() if k not in excluded}
            if not left:
                continue
            below = sum(left.values()) + len(left)
            if s[i] in left:
                p *= left[s[i]] / below
                done = True
                break
            p *= len(left) / below
            excluded |= set(seen)
        total += log10(p if done else p / max(1, 256 - len(excluded)))
    return total


def test_partial_matching_scores(docs, odd):
    train = id_bucket("_id", 5) != 1
    for df in (docs, odd):
        rows = df.select("doc_id", "text", train_flag(df).alias("t")).collect()
        words = Counter(w for r in rows if r["t"] for w in tokens(r["text"] or ""))
        n, v, table = sum(words.values()), len(words), plain_trie(words, 4)
        expected = []
        for r in rows:
            t = tokens(r["text"] or "")
            expected.append((r["doc_id"], r["t"], len(t), sum(w in words for w in t), n,
                             sum(log10((words.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t),
                             sum(k * plain_log10(table, w, 4) for w, k in Counter(t).items())))
        for frequent in (50_000, 3):
            got = sorted((tuple(r) for r in score_documents(df, train, frequent=frequent).collect()), key=repr)
            for g, e in zip(got, sorted(expected, key=repr), strict=True):
                assert g[:5] == e[:5]
                assert g[5:] == pytest.approx(e[5:], rel=1e-9)


def train_flag(df):
    return id_bucket("doc_id", 5) != 1


def test_scores_without_training(docs, none):
    assert score_documents(none, F.lit(True)).count() == 0
    row = score_documents(docs.filter("doc_id = 13"), F.lit(False)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] < 0


def test_every_edge_counts(spark):
    # Rare contexts among more than 524,288 coded bytes: one in so many was the least that counted.
    rows = [(0, "the cat " * 300_000), (1, "tah tah"), (2, "tah")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = Counter({b"the": 300_000, b"cat": 300_000, b"tah": 2, b"\n": 2})
    table = plain_trie(words, 4)
    got = {r["doc_id"]: r["score"] for r in score_documents(df, F.col("_id") != 2).collect()}
    assert got[2] == pytest.approx(plain_log10(table, b"tah", 4) + plain_log10(table, b"\n", 4))


def test_contexts_across_words(spark):
    rows = [(0, "new york city " * 20), (1, "new york"), (2, "york new")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in (1 << 21, 3):
        got = {r["doc_id"]: r["score"] for r in score_documents(df, F.col("_id") == 0, across=True, frequent_windows=frequent).collect()}
        # The end after "york" and after "new" was never seen; what is left is the order of words.
        table = defaultdict(Counter)
        s = b" " + rows[0][1].encode().strip() + b" \n"
        for i in range(1, len(s)):
            for d in range(min(4, i) + 1):
                table[s[i - d:i]][s[i]] += 1
        for i in (0, 1, 2):
            assert got[i] == pytest.approx(plain_stream(table, b" " + rows[i][1].encode().strip() + b" \n"))
        assert got[1] != pytest.approx(got[2])


def plain_stream(table, s):
    total = 0.0
    for i in range(1, len(s)):
        p, excluded = 1.0, set()
        for d in range(min(4, i), -1, -1):
            left = {k: v for k, v in table.get(s[i - d:i], {}).items() if k not in excluded}
            if not left:
                continue
            if s[i] in left:
                p *= left[s[i]] / (sum(left.values()) + len(left))
                break
            p *= len(left) / (sum(left.values()) + len(left))
            excluded |= set(left)
        else:
            p /= max(1, 256 - len(excluded))
        total += log10(p)
    return total


def test_probabilities_add_up():
    words = Counter({b"the": 5, b"then": 2, b"a": 3, b"\n": 2})
    keys = defaultdict(int)
    for context, seen in plain_trie(words, 2).items():
        for symbol, c in seen.items():
            keys[len(context), int.from_bytes(context + bytes([symbol]), "big")] += c
    d, e = np.array([k[0] for k in keys]), np.array([k[1] for k in keys])
    trie = Trie(2, d, e, np.array(list(keys.values())))
    # All first bytes of a word, and the end: the closing space of one-byte words is taken off.
    table = plain_trie(words, 2)
    singles = [bytes([b]) for b in range(256) if b not in b" \n"]
    first = sum(10 ** (plain_log10(table, w, 2) - plain_close(table, w)) for w in singles) + 10 ** plain_log10(table, b"\n", 2)
    # What is missing is the share of a space, which no word begins with.
    assert 0.9 < first <= 1.0 + 1e-9
    assert trie.log10_words(singles).tolist() == pytest.approx([plain_log10(table, w, 2) for w in singles])


def plain_close(table, word):
    s = b" " + word
    p, excluded = 1.0, set()
    for d in (2, 1, 0):
        seen = table.get(s[len(s) - d:] if d else b"")
        left = {k: v for k, v in (seen or {}).items() if k not in excluded}
        if not left:
            continue
        below = sum(left.values()) + len(left)
        if 32 in left:
            return log10(p * left[32] / below)
        p *= len(left) / below
        excluded |= set(seen)
    return log10(p / max(1, 256 - len(excluded)))


@pytest.mark.parametrize("source", ["docs", "odd", "none"])
def test_packing(request, source):
    df, library = request.getfixturevalue(source), Tokenizer.from_file(BYTE_BPE)
    rows = pack_documents(df, BYTE_BPE, end_id=1, shard_docs=64).collect()
    texts = Counter()
    for r in df.select("doc_id", "text").collect():
        texts[r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    for (doc, ids), times in texts.items():
        own = [p for p in pieces[doc] if p["doc_tokens"] == len(ids)]
        if times == 1 and len({t for t in texts if t[0] == doc}) == 1:
            got, at = [], 0
            for p in sorted(own, key=lambda p: p["start"]):
                assert p["start"] == at
                got += np.frombuffer(p["ids"], "<u4").tolist()
                at += p["length"]
            assert tuple(got) == ids
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in texts.items())


def test_windows_take_every_neighbour_by_score():
    # The seed shares its last id, not among its heaviest, with 100 documents; as many without one come first.
    seed = np.arange(1, 41)
    other = [np.array([50, 51]) for _ in range(100)]
    near = [np.array([40, 52]) for _ in range(100)]
    idf = np.full(60, 2.0)
    idf[40] = 0.5
    pieces = next(Shard([seed, *other, *near], idf, 3.0).windows(40 + 200))
    assert {p[0] for p in pieces} == {0, *range(101, 201)}


def test_exact_search(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = sorted(con.execute(ORACLE["op2_topk"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op2_topk"](spark, SF).collect())
    assert got == expected and len(got) == 50
    small = exact_top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), ASKED, block_rows=60, query_rows=3)
    assert sorted(tuple(r) for r in small.collect()) == expected


@pytest.fixture(scope="module")
def vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, [0.0, 0.0]), (8, [1.0]), (9, [-1.0, 0.5]), (50, [2.0, 0.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0]), (150, [-0.0, 1e300]), (2, [2.0, 0.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS _id", "2 AS _x", "3 AS rank", "4 AS score")


def test_odd_vectors(vectors, spark):
    got = defaultdict(list)
    for r in approximate_neighbours(vectors, ASKED).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    assert sorted(got) == [0, 50, 150]
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 50, 1.0), (4, 150, 0.0), (5, 9, round(-1 / 1.25 ** 0.5, 9))]
    assert [v for _, v, _ in sorted(got[50])] == [0, 1, 2, 150, 9]
    top = defaultdict(list)
    for r in exact_top_k(vectors.filter("vec_id <> 150 or vec_id is null"), ASKED).collect():
        top[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(top[0]) == [(1, 1, 131072), (2, 2, 131072), (3, 50, 131072), (4, 7, 0), (5, 100, 0)]
    assert len(top[100]) == 5 and all(s == 0 for _, _, s in top[100])
    empty = vectors.filter("vec_id < 0")
    assert approximate_neighbours(empty, ASKED).count() == exact_top_k(empty, ASKED).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows["vec_id"].to_numpy()
    got = defaultdict(set)
    for r in approximate_neighbours(df, ASKED).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -2
        best = set(ids[np.argsort(-score)[:5]].tolist())
        hits, total = hits + len(best & got[ids[q]]), total + 5
    assert hits / total >= 0.9


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 48))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    # About 1,000 lists, cut into blocks, as are their queries.
    for r in approximate_neighbours(df, ASKED, list_rows=4, block_rows=16, recall=0.999).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 50):
        score = x @ x[q]
        score[q] = -2
        hits += len(set(np.argsort(-score)[:5].tolist()) & got[q])
    assert hits / 400 >= 0.99


def test_queries_search_chosen_lists_only(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(64, 32))[rng.integers(0, 64, 20_000)] + 0.3 * rng.normal(size=(20_000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    made = posting_lists(df, ASKED)
    sizes = {r["_list"]: r["count"] for r in made.lists.groupBy("_list").count().collect()}
    pairs = sum(sizes.get(r["_list"], 0) for r in made.asked.collect())
    # Rows compared, copies in several lists included, against those of brute force.
    assert pairs < 0.3 * 400 * 20_000
    got = defaultdict(set)
    for r in approximate_neighbours(df, ASKED).collect():
        got[r["query_id"]].add(r["vec_id"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 20_000, 50):
        score = x @ x[q]
        score[q] = -2
        hits += len(set(np.argsort(-score)[:5].tolist()) & got[q])
    print(f"share of rows compared {pairs / 400 / 20_000:.3f}, reach {made.reach:.3f}, recall {hits / 2000:.3f}")
    assert hits / 2000 >= 0.9


def test_graph_walk_finds_what_lies_within_the_ratio():
    rng = np.random.default_rng(3)
    points, asked = (rng.normal(size=(n, 24)) for n in (6000, 200))
    points, asked = (p / np.linalg.norm(p, axis=1, keepdims=True) for p in (points, asked))
    graph = CentroidGraph(balanced_centroids(points, 700))
    rows, lists = graph.within(asked, 1.2)
    far = np.sqrt(np.maximum(2 - 2 * asked @ graph.centroids.T.astype(float), 0))
    true = far <= 1.2 * far.min(axis=1, keepdims=True)
    assert len(rows) == len(set(zip(rows.tolist(), lists.tolist())))
    assert true[rows, lists].mean() > 0.98 and true[rows, lists].sum() > 0.98 * true.sum()


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, before = docs, None
    frames = []
    for _, stage in p.STAGES:
        kept = stage(spark, kept, SF).cache()
        frames.append(kept)
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    everything = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = [i for i in everything if labels.get(i) == 1]
    assert len(ids[0] & set(good)) > 0.95 * len(good)
    assert all(a <= b for a, b in zip(ids[1:], ids))
    groups = components([(i, fingerprint(everything[i])) for i in ids[1]])
    assert ids[2] == {groups[fingerprint(everything[i])] for i in ids[1]}
    assert ids[3] == ids[2] == ids[4]
    assert all("@" not in r["text"] or "[EMAIL]" not in r["text"] for r in frames[3].filter("text like '%[EMAIL]%@%.%'").collect())
    assert all(r["n_chars"] == len(r["text"]) for r in frames[3].collect())
    assert {r["doc_id"] for r in p.run(spark, SF).collect()} == ids[4]


def test_near_copies_keep_documents_without_id(spark):
    from corpus_pipeline import near_copies

    rows = [(3, "one two three four"), (2, "one two three four"), (2, "one two three four"), (None, "lonely text without id"),
            (None, "another text without any id"), (None, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([rows[1], *rows[3:]], key=str)
