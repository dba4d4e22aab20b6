"""SimHash, components, decontamination and search against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from colmap.llm import decontam, search, simhash
from colmap.llm.components import components
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    n, bits = max(1, len(w) - k + 1), [0] * 64
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), seed=42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > n)


def reach(values, d):
    """Component of each value: the least index in reach."""
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= d:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for text in [None, "", " \n", "one", "A b", "a  B\tc", "Ünï code çé " * 50, "x y z " * 40_000]:
        assert simhash.fingerprint_of(text, 3) == slow_fingerprint(text)


def test_near_duplicates_small(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs).collect()}
    pairs = sorted((r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect())
    ids, fps = zip(*pairs)
    assert {i: v[0] & (1 << 64) - 1 for i, v in got.items()} == dict(pairs)
    assert [got[i][1] for i in ids] == [ids[r] for r in reach(fps, 3)]


@pytest.mark.parametrize("bits, posting", [
    (0, 4096), (1, 4096), (3, 4096), (4, 4096), (4, 8), (5, 8), (6, 8), (7, 8)])
def test_links_reach_all_close_pairs(spark, monkeypatch, bits, posting):
    monkeypatch.setattr(simhash, "POSTING", posting)
    rnd = random.Random(bits)
    values = set()
    for _ in range(25):
        centre = rnd.getrandbits(64)
        for _ in range(8):
            flipped = centre
            for _ in range(rnd.randint(0, 5)):
                flipped ^= 1 << rnd.randrange(64)
            values.add(flipped)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    linked = simhash.links(df, bits).collect()
    for a, b in linked:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= bits
    at = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == reach(values, bits)


def test_long_entries_are_refined(spark, monkeypatch):
    """More fingerprints in an entry than a task takes at once."""
    monkeypatch.setattr(simhash, "POSTING", 8)
    monkeypatch.setattr(simhash, "BUFFER", 16)
    rnd = random.Random(5)
    values = sorted({0x0123456789ABCDEF ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
                     ^ (1 << rnd.randrange(20)) for _ in range(150)})
    nodes = {v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(v,) for v in nodes], "fp long")
    n_roots = len(set(reach(values, 3)))
    stars = components(simhash.links(df, 3)).collect()
    assert len(nodes) - len({u for u, _ in stars}) == n_roots


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100)],
                                  "a long, b long")
    got = dict(components(links).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90}


def test_simhash_edges(spark, edges, no_docs):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["component_id"] == by[2][0]["component_id"] == 1
    assert {by[i][0]["component_id"] for i in (3, 4, 5)} == {3}
    assert [r["component_id"] for r in by[9]] == [9, 9]
    assert by[None][0]["component_id"] is None
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 7, 8, 9, 10, 10]
    assert simhash.keep_one(no_docs).count() == 0


def test_decontamination_finds_short_items_in_long_texts(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([6, 12, 40, 200]))))
             for i in range(30)]
    items += [(90, items[0][1].upper()), (91, ""), (92, None), (93, "only four words here")]
    docs = []
    for d in range(60):
        w = rnd.choices(vocabulary, k=rnd.choice([0, 3, 50, 3000]))
        if d % 2:
            part = items[d % 30][1].split()
            for _ in range(rnd.choice([0, 0, 1, 3])):
                part[rnd.randrange(len(part))] = "other"
            w = w + part + rnd.choices(vocabulary, k=5)
        docs.append((d, " ".join(w)))
    docs += [(60, "Only four\twords here"), (61, "see only four words here now")]

    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for i, text in items:
        if i != 90 and shingles(text):
            for d, body in docs:
                n = len(shingles(text) & shingles(body))
                if n >= 0.8 * len(shingles(text)) - 1e-9:
                    want.add((d, i, len(shingles(text)), n))
    got = decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"),
                             spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r)[:4] for r in got.collect()} == want
    assert len(want) > 15


def test_decontamination_edges(spark, edges, no_docs):
    items = spark.createDataFrame(
        [(1, "brown fox jumps over the lazy dog"), (None, "null id here, write to a.b@c.example"),
         (3, None)], "item_id long, text string")
    found = decontam.contained(edges, items)
    assert sorted(r[0] or 0 for r in found.collect()) == [0, 1, 2]
    left = decontam.without_benchmark(edges, items)
    assert left.columns == edges.columns and left.count() == edges.count() - 3
    assert decontam.contained(no_docs, items).count() == 0
    assert decontam.without_benchmark(edges, items.limit(0)).count() == edges.count()


def test_search_edges(spark, edges, no_docs):
    asked = spark.createDataFrame(
        [(1, "quick FOX"), (2, None), (3, "nothing-matches-zzz"), (4, "12345"), (4, "12345")],
        "query_id long, text string")
    got = search.top_k(edges, asked, k=1).collect()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got) == [
        (1, 1, 1), (4, 9, 1), (4, 9, 1)]
    assert search.top_k(no_docs, asked).count() == 0
    assert search.top_k(edges, asked.limit(0)).count() == 0


def _search_case(n_docs=300, n_asked=20):
    """Documents and the plain BM25 result of the first ones as queries."""
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"t{min(int(x), 60)}" for x in rnd.zipf(1.4, rnd.integers(1, 40)))
             for _ in range(n_docs)]
    split = [t.split() for t in texts]
    mean = sum(map(len, split)) / len(split)
    df = {}
    for s in split:
        for t in set(s):
            df[t] = df.get(t, 0) + 1
    want = []
    for q in range(n_asked):
        scored = []
        for d, s in enumerate(split):
            score = sum(round(float(
                np.log(1 + (n_docs - df[t] + 0.5) / (df[t] + 0.5)) * (
                    s.count(t) * 2.2 / (s.count(t) + 1.2 * (0.25 + 0.75 * len(s) / mean)))
                * 1_000_000)) for t in set(split[q]) & set(s))
            if score:
                scored.append((-score, d))
        want += [(q, d, -s / 1_000_000, r + 1) for r, (s, d) in enumerate(sorted(scored)[:10])]
    return texts, split, df, mean, want


@pytest.mark.parametrize("shard_docs, queries", [(8192, 1024), (40, 6), (40, 1024), (1000, 3)])
def test_search_is_exact(spark, monkeypatch, shard_docs, queries):
    """One or many shards, blocks of queries and groups of shards against plain scoring."""
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(search, "QUERIES", queries)
    texts, _, _, _, want = _search_case()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = docs.where("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    got = sorted((tuple(r) for r in search.top_k(docs, asked).collect()),
                 key=lambda g: (g[0], g[3]))
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


@pytest.mark.parametrize("block, dense, shard", [(4, 3, 300), (16, 1, 70), (7, 20, 33), (300, 2, 1)])
def test_search_prunes_and_stays_exact(monkeypatch, block, dense, shard):
    """Small blocks, so that bounds and bars of earlier shards decide."""
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "DENSE", dense)
    monkeypatch.setattr(search, "BATCH", 6)
    _, split, df, mean, want = _search_case()
    terms = pa.array(sorted(df))
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    counts = np.array([df[t] for t in terms.to_pylist()], float)
    queries = [np.array([number[t] for t in dict.fromkeys(split[q])]) for q in range(20)]
    found = search.nothing_found(20)
    for at in range(0, 300, shard):
        part = split[at:at + shard]
        made = search.Segment(np.arange(at, at + len(part)), pa.array(part, pa.list_(pa.string())))
        segment = search.Segment.unpack(made.pack())
        scorer = search.Scorer(segment, terms, counts, 300, mean)
        search.search_segment(segment, scorer, queries, 10, found)
    got = [(q, int(d), s / search.SCALE, r + 1) for q, (scores, ids) in enumerate(found)
           for r, (s, d) in enumerate(zip(scores, ids, strict=True))]
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_search_splits_texts_once(spark, edges, monkeypatch):
    """Frequencies come from the indexes: documents and queries are split once each, and
    the table of all words is not broadcast."""
    split, hints, plain = [], [], search.words
    monkeypatch.setattr(search, "words", lambda text: split.append(text) or plain(text))
    hint = type(edges).hint
    monkeypatch.setattr(type(edges), "hint", lambda df, *a: hints.append(a) or hint(df, *a))
    asked = spark.createDataFrame([(1, "quick FOX")], "query_id long, text string")
    assert search.top_k(edges, asked, k=1).count() == 1
    assert len(split) == 2 and ("merge",) in hints


def test_search_sums_beyond_single_precision():
    """Scores one unit apart at 2**28, where single precision keeps steps of 32."""
    n = 200
    segment = search.Segment(np.arange(n), pa.array([["a", "b"]] * n, pa.list_(pa.string())))
    scorer = search.Scorer(segment, pa.array([f"t{i}" for i in range(40)] + ["a"]),
                           np.ones(41), n, 2.0)
    assert scorer.matrix.dtype == np.float32
    scorer.known[:] = True
    scorer.dense, scorer.dense_row = np.arange(41), np.arange(41)
    scorer.matrix = np.full((n, 41), (1 << 23) - 1, np.float32)
    scorer.matrix[:, 40] = np.arange(n)
    scorer.top = np.full((41, 1), float(1 << 23))
    found = search.nothing_found(1)
    search.search_segment(segment, scorer, [np.arange(41)], 10, found)
    top = np.argsort(-scorer.matrix[:, 40], kind="stable")[:10]
    assert found[0][1].tolist() == segment.doc_ids[top].tolist()
    assert found[0][0].tolist() == [40 * ((1 << 23) - 1) + n - 1 - i for i in range(10)]


def test_search_prepares_an_index_once_for_thousands_of_queries(spark, monkeypatch):
    """3,000 queries are one block, so no index is unpacked and weighed a second time."""
    blocks, plain = [], search._search
    monkeypatch.setattr(search, "_search", lambda *a: blocks.append(a[1]) or plain(*a))
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id, ' all') AS text")
    asked = docs.withColumnRenamed("doc_id", "query_id")
    got = search.top_k(docs, asked, k=1).collect()
    assert blocks == [1]
    assert len(got) == 3000 and all(r["query_id"] == r["doc_id"] for r in got)


def test_search_batches_of_unknown_and_rare_terms():
    """Queries of which a segment knows no term, some, or rare ones only, in one batch."""
    segment = search.Segment(np.arange(3), pa.array(
        [["a", "b"], ["a"], ["c", "a"]], pa.list_(pa.string())))
    scorer = search.Scorer(segment, pa.array(["x", "a", "y", "c", "b"]), np.ones(5), 3, 5 / 3)
    scorer.dense_row[[3, 4]] = -1
    scorer.matrix[:, np.isin(scorer.dense, [3, 4])] = 0
    queries = [np.array(q, np.int64) for q in ([0], [3], [0, 2], [4, 1, 0], [2, 3, 4])]
    found = search.nothing_found(5)
    search.search_segment(segment, scorer, queries, 10, found)
    assert [sorted(ids.tolist()) for _, ids in found] == [[], [2], [], [0, 1, 2], [0, 2]]
    assert found[3][1].tolist()[0] == 0


def test_search_orders_queries_by_their_words():
    """Queries of two languages that come in turn are separated."""
    rnd = np.random.default_rng(5)
    queries = [np.unique(rnd.integers(0, 40, 12) + 40 * (i % 2)) for i in range(60)]
    order = search.alike(queries, 90)
    assert sorted(order) == list(range(60))
    assert np.count_nonzero(np.diff(order % 2)) <= 7  # at most one change in each of 2**3 parts
    assert search.alike(queries[:1], 90).tolist() == [0]


@pytest.mark.parametrize("products", [0, 1, 4, 10_000])
def test_search_is_exact_whichever_terms_are_multiplied(monkeypatch, products):
    """Frequent terms go through the matrix or the postings, by how many of a batch have them."""
    monkeypatch.setattr(search, "PRODUCTS", products)
    monkeypatch.setattr(search, "BATCH", 6)
    monkeypatch.setattr(search, "BLOCK", 70)
    _, split, df, mean, want = _search_case()
    terms = pa.array(sorted(df))
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    queries = [np.array([number[t] for t in dict.fromkeys(split[q])]) for q in range(20)]
    segment = search.Segment(np.arange(300), pa.array(split, pa.list_(pa.string())))
    scorer = search.Scorer(
        segment, terms, np.array([df[t] for t in terms.to_pylist()], float), 300, mean)
    found = search.nothing_found(20)
    search.search_segment(segment, scorer, queries, 10, found)
    got = [(q, int(d), s / search.SCALE, r + 1) for q, (scores, ids) in enumerate(found)
           for r, (s, d) in enumerate(zip(scores, ids, strict=True))]
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
