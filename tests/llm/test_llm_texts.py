"""Sentencepiece ids, periodic runs and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from colmap.llm import importance, periodic, pieces, queries
from colmap.llm.common import Remembered, words
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_remembered():
    made = []
    known = Remembered(lambda k: made.append(k) or k * 2, 4)
    assert [known[k] for k in (1, 2, 1, 3, 1, 4, 5, 6, 7, 1)] == [2, 4, 2, 6, 2, 8, 10, 12, 14, 2]
    assert made.count(2) == 1 and len(known) + len(known.older) <= 4


# ---- sentencepiece

@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_are_those_of_the_library(model):
    rnd = random.Random(5)
    own = pieces.PieceEncoder(MODEL)
    listed = list(own.ids)
    odd = [" ", "  ", "\n", "\t", "\r", pieces.SPACE, "😀", "́", "\x00", "<s>", "<0x0A>", "é",
           "İ", "²", "_", "'s", "a", "th", "ing", "...", "12"]
    for _ in range(3000):
        kind, n = rnd.random(), rnd.randint(0, 12)
        if kind < 0.4:
            text = "".join(rnd.choice(listed) for _ in range(n))
        elif kind < 0.7:
            text = "".join(rnd.choice(odd) for _ in range(3 * n))
        else:
            text = "".join(rnd.choice("abeinstr ") for _ in range(6 * n))
        ids = own.encode(text)
        assert ids.tolist() == model.encode(text), text
        assert own.decode(ids) == model.decode(model.encode(text))
    assert own.encode(None).tolist() == [] == own.encode("").tolist()


def test_whole_texts_without_units_and_a_dead_end(model):
    own = pieces.PieceEncoder(MODEL)
    own.units = lambda text: [text]
    for text in ("a" * 999, " " * 501, "the quick\nbrown  fox, 42 times", "ababab" * 90):
        assert own.encode(text).tolist() == model.encode(text)
    # the longest pieces first would not do: some are taken back
    assert any(
        own.pieces(w) != greedy(own, w)
        for w in ("unbelievable", "reinterpretation", "Lichungie", "dieerölichver"))


def greedy(own, word):
    found = []
    while word:
        n = next((n for n in range(len(word), 1, -1) if word[:n] in own.ids), 1)
        found.append(word[:n])
        word = word[n:]
    return found


def test_op11(spark, model, edges, no_docs):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_sentencepiece(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = model.encode(text or "")
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(model.decode(ids))
    found = edges.withColumn("ids", pieces.encoded(F.col("text"), MODEL))
    assert found.columns == edges.columns + ["ids"]
    for r in found.collect():
        assert r["ids"]["ids"] == model.encode(r["text"] or "")
        assert r["ids"]["decoded"] == (r["text"] or "")
    assert no_docs.select(pieces.encoded(F.col("text"), MODEL)).count() == 0


# ---- periodic runs

def brute_runs(x, copies=4, least=6):
    found = []
    for q in range(1, len(x) // copies + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, copies * q) and not any(
                    all(x[t] == x[t + d] for t in range(start, start + length - d))
                    for d in range(1, q)):
                found.append((start, length, q))
            i = max(i, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_transform_and_its_matches():
    rnd = np.random.default_rng(1)
    for block in (1, 2, 8, 32, 128):
        size = 2 * block
        rows = rnd.integers(0, periodic.PRIME, (3, size)).astype(np.uint64)
        back = periodic.inverse(periodic.forward(rows.copy()), size)
        assert (back == rows * np.uint64(size) % np.uint64(periodic.PRIME)).all()
        x = rnd.integers(0, 2, 6 * block).astype(np.uint64)
        x[3 * block:] = x[:3 * block]
        padded = np.concatenate([x, np.zeros(4 * block, np.uint64)])
        squares = np.concatenate([[0], np.cumsum(padded * padded)]).astype(np.uint64)
        got = periodic.matches(padded, squares, block, 0, 3)
        for j in range(3):
            for o in range(block):
                a, b = j * block, j * block + block + o
                assert got[j, o] == (padded[a:a + block] == padded[b:b + block]).all()


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(periodic, "SLICE", rnd.choice([4, 64, 1 << 20]))
    for _ in range(150):
        n, k = rnd.randint(0, 120), rnd.choice([1, 2, 2, 3, 40])
        x = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n > 4 else 0):
            a = rnd.randrange(n)
            q = rnd.randint(1, max(1, (n - a) // 3))
            for i in range(a + q, min(n, a + rnd.randint(1, 6) * q + rnd.randint(0, 3))):
                x[i] = x[i - q]
        for copies, least in ((4, 6), (5, 1)):
            assert periodic.find_runs(
                np.array(x, np.uint64), n, copies, least) == brute_runs(x, copies, least)


def test_long_repetitive_texts():
    x = np.zeros(50_000, np.uint64)
    assert periodic.find_runs(x, len(x), 4, 6) == [(0, 50_000, 1)]
    unit = np.concatenate([np.zeros(200), [1], np.zeros(200), [2]])
    x = np.tile(unit, 40).astype(np.uint64)
    found = periodic.find_runs(x, len(x), 4, 6)
    assert found[1] == (0, len(x), 402) and len(found) == 81
    # the least number of copies, and one word less
    x = np.arange(9000, dtype=np.uint64)
    x[100:4100] = np.tile(np.arange(1000), 4)
    assert periodic.find_runs(x, len(x), 4, 6) == [(100, 4000, 1000)]
    x[4099] = 8999
    assert periodic.find_runs(x, len(x), 4, 6) == []


def planted(doc_id, text):
    x = WORD.findall(text or "")
    if doc_id is None or not x:
        return x
    n, h = len(x), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    return x


def collapsed(x, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def test_op12(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        x, r = planted(doc_id, text), got[doc_id]
        runs = brute_runs(x) if len(x) < 1500 else periodic.find_runs(
            np.unique(np.array(x, object), return_inverse=True)[1].astype(np.uint64), len(x), 4, 6)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(collapsed(x, runs))
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5


def test_runs_on_edges(spark, edges, no_docs):
    found = edges.withColumn("found", periodic.runs(words(F.col("text"))))
    assert found.columns == edges.columns + ["found"]
    for r in found.collect():
        x = WORD.findall(r["text"] or "")
        runs = [tuple(run) for run in r["found"]["runs"]]
        assert runs == ([(0, 200_000, 5)] if len(x) > 1000 else [])
        assert r["found"]["collapsed"] == collapsed(x, runs)
    nulls = spark.range(3).select(periodic.runs(F.lit(None).cast("array<string>")).alias("f"))
    assert [(r["f"]["runs"], r["f"]["collapsed"]) for r in nulls.collect()] == [([], "")] * 3
    assert no_docs.select(periodic.runs(words(F.col("text")))).count() == 0
    tied = spark.sql("select array(named_struct('start', 0L, 'length', 8L, 'period', 2L), "
                     "named_struct('start', 9L, 'length', 12L, 'period', 3L)) r")
    assert tied.select(periodic.strongest(F.col("r"))["start"]).first()[0] == 0


# ---- importance resampling

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    x = FEATURE_WORD.findall(lowered(text))
    return len(x), [" ".join(x[i:i + n]) for n in range(1, longest + 1)
                    for i in range(len(x) - n + 1)]


def brute_resampling(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / (
        (s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows, can = [], []
    for doc_id, text in docs:
        n, found = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found)
        key = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(sha(key)[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
        if n >= least:
            can.append(rows[-1])
    can.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(can[:percent * len(can) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=repr)


def test_op13(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(
        "doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select(
        "text").collect()]
    got = queries.op13_importance(spark, SMALL).collect()
    assert sorted(map(tuple, got), key=repr) == brute_resampling(docs, target)


@pytest.mark.parametrize("longest, buckets", [(1, 7), (2, 10_000), (3, 500)])
def test_resampling(spark, edges, longest, buckets):
    rnd = random.Random(longest)
    texts = [" ".join(rnd.choice(["Ab", "cd1", "é-ß", "x.y", "ÄB", "zz"]) for _ in range(
        rnd.randint(0, 30))) for _ in range(120)]
    docs = [(i // 2 * 2, t) for i, t in enumerate(texts)] + [
        (r["doc_id"], r["text"]) for r in edges.collect()]
    # equal ids and scores stay tied only for equal texts
    docs = list(dict(docs).items()) + [(500, texts[0]), (500, texts[0])]
    frame = spark.createDataFrame(
        [(t, i, "w", 1) for i, t in docs], "text string, doc_id long, weight string, rank int")
    target = spark.createDataFrame([(t,) for t in (*texts[:9], None, "")], "text string")
    got = importance.resampled(
        frame.repartition(5), target, longest, buckets, percent=40, min_words=3)
    want = brute_resampling(docs, [*texts[:9], None], longest, buckets, 40, 3)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_resampling_of_nothing(spark, edges, no_docs):
    empty = spark.createDataFrame([], "text string")
    assert importance.resampled(no_docs, empty).count() == 0
    assert importance.resampled(edges, empty).count() == edges.count()
    assert importance.resampled(no_docs, edges.select("text")).count() == 0
    assert importance.TABLE[ord("Z")] == ord("z") and importance.TABLE[0xC3] == 0xC3
