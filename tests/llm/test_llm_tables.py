"""Mixing, sharding, token files, the pipeline and the registered queries."""

import io
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colmap.llm import mixing, queries, sharding, tokens
from tests.conftest import SMALL
from tests.test_oracles import normal

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- mixing

def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, 10, 500, 90_000]) for i in range(rnd.randint(1, 9))}
    sizes[None] = 40
    got = mixing.targets(spark.createDataFrame(
        list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r["source"]: round(r["target"], 6) for r in got} == {
        s: round(t, 6) for s, t in want.items()}


def test_sizes(spark):
    texts = [None, "", " ", "a", " a", "a ", " a b\t", "\n\n", "é x y", "a\x1cb c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        mixing.size_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(WORD.findall(t or "")) for t in texts]


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.draws(docs, shards=8).select("doc_id", "source", "mix.*").collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want, taken = filled(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r["copies"] <= 2 and len(r["shards"]) == r["copies"]
        assert all(0 <= s < 8 for s in r["shards"])
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] for s in want)
    again = mixing.draws(docs.repartition(5), shards=8).select("doc_id", "source", "mix.*").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    copies = mixing.mixed(docs, shards=8)
    assert copies.count() == sum(r["copies"] for r in rows)
    assert copies.columns == docs.columns + ["shard", "place"]


def test_small_sources_come_as_near_as_documents_can(spark):
    """Against all choices of documents; repeated rows are taken together."""
    rnd = random.Random(5)
    rows = []
    for source in range(25):
        for _ in range(rnd.randint(1, mixing.SIDE)):
            text = " ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.choice([0, 1, 7, 40, 300])
                                                                   + rnd.randint(0, 20)))
            rows.append((len(rows), text, f"s{source:02d}"))
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.draws(docs, shards=4).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(rows)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        target, whole = own[0]["target"], sum(r["size"] for r in own)
        sizes = {}
        for r in own:
            sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["size"]
        sums = {0}
        for n in sizes.values():
            sums |= {x + n for x in sums}
        taken = sum(r["copies"] * r["size"] for r in own)
        reachable = sums | {x + whole for x in sums}
        assert abs(taken - round(target)) <= min(abs(x - round(target)) for x in reachable), source
        assert all(r["copies"] <= 2 and len(r["shards"]) == r["copies"] for r in own)


def test_sources_of_the_table_come_near(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = mixing.draws(docs).select("source", "mix.*").groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"))
    assert found.where(F.abs(F.col("taken") - F.col("target")) > 0.015 * F.col("target")).count() == 0


def test_splitting_tree(spark):
    """Quotas are kept, shards get equal shares, and draws have the right mean."""
    quotas = spark.createDataFrame([(1, 600), (2, 0), (3, 200)], "source_no int, units long")
    got = mixing.split_tree(quotas, 5, 3).collect()
    by_source, by_shard = {}, {}
    for r in got:
        by_source[r["source_no"]] = by_source.get(r["source_no"], 0) + r["units"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["units"]
    assert by_source == {1: 600, 2: 0, 3: 200}
    assert sorted(by_shard) == [0, 1, 2, 3, 4] and set(by_shard.values()) <= {159, 160, 161}
    assert all(90 <= r["units"] <= 150 for r in got if r["source_no"] == 1)
    assert mixing.split_tree(quotas, 1, 3).count() == 3


def test_mix_edges(spark, edges, no_docs):
    got = mixing.draws(edges)
    assert got.columns == edges.columns + ["_mix"] and got.count() == edges.count()
    rows = got.select("doc_id", "source", "_mix.*").collect()
    assert all(r["copies"] <= 2 for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert mixing.draws(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0


# ---- sharding

def check_shards(rows, n_rows):
    assert len(rows) == n_rows
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.sharded(docs, shards=7).collect()
    check_shards(rows, docs.count())
    total = [0] * 7
    for r in rows:
        total[r["shard"]] += r["size"]
    assert max(total) < 1.03 * sum(total) / 7 and min(total) > 0.97 * sum(total) / 7
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    where = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        where.setdefault(raw, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 6
    by_bytes = sharding.sharded(docs, target_bytes=sum(total) // 7)
    assert by_bytes.select("shard").distinct().count() == 7


def test_shards_of_copies(spark):
    """One value in all rows is split; nothing tells the rows apart but their number."""
    docs = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 92).alias("text"),
                                   F.lit("s").alias("source"), F.lit("l").alias("lang"))
    rows = sharding.sharded(docs, shards=4).collect()
    slots = check_shards(rows, 400)
    assert all(90 <= len(s) <= 110 for s in slots.values())


def test_small_shards_are_near_equal(spark):
    """Documents of a tenth of a shard, and 24 shards, so that cuts leave much to even out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.sharded(docs, shards=24).collect()
    check_shards(rows, docs.count())
    total = [0] * 24
    for r in rows:
        total[r["shard"]] += r["size"]
    assert max(total) < 1.03 * sum(total) / 24 and min(total) > 0.97 * sum(total) / 24
    # equal texts, where they are few, stay together
    places = {}
    for r in rows:
        places.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(p) == 1 for p in places.values())


def test_shard_edges(spark, edges, no_docs, folder):
    rows = sharding.sharded(edges, shards=3).collect()
    check_shards(rows, edges.count())
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(8, 0)}
    assert sharding.sharded(no_docs, shards=3).count() == 0
    assert sharding.sharded(edges, shards=1).select("shard").distinct().count() == 1
    sharding.write_shards(edges, f"{folder}/shards", 3)
    back = spark.read.parquet(f"{folder}/shards")
    assert back.count() == edges.count() and set(edges.columns) < set(back.columns)


# ---- token files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("words", [1, 3, 50])
def test_words_are_encoded_as_whole_texts_are(monkeypatch, words):
    monkeypatch.setattr(tokens, "CACHE_WORDS", words)
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(PATH)
    rnd = random.Random(8)
    parts = ["Don't", "ΣΊΣΥΦΟΣ", "İx", "<|endoftext|>", "a<|startoftext|>b", "<|", "naïve", "x\x1cy",
             " ", "é", "漢字", "12.5%", " ", "'ll", "über", "\x85", "😀", "́", "Word", "word,", "ok...", "ª!", "ǅx", "ﬁn", "?"]
    texts = ["".join(p + rnd.choice(["", " ", "\n", "\t\x0b"]) for p in rnd.choices(parts, k=12))
             for _ in range(200)] + [None, "", "  "]
    got = tokens.WordEncoder(PATH).encode(texts)
    for t, ids in zip(texts, got, strict=True):
        want = plain.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t


def test_file_format():
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, top, n).astype("<u4") for top, n in
            [(200, 1500), (50_000, 900), (1, 0), (2**32, 700), (2**24, 1), (300, 513)]]
    ids = [5, None, -3, 2**40, 7, 8]
    raw = tokens.encode_file(ids, [d.tobytes() for d in docs])
    file = tokens.TokenFile(io.BytesIO(raw))
    every = np.concatenate(docs)
    assert file.n_tokens == len(every) and len(file.levels) == 4
    assert [file.token(i) for i in range(0, len(every), 7)] == every[::7].tolist()
    for a, b in [(0, len(every)), (3, 3), (1499, 1502), (2390, 3200), (511, 1025)]:
        assert file.tokens(a, b).tolist() == every[a:b].tolist()
    found, starts = file.documents(0, 6)
    assert found.tolist() == [5, tokens.NO_ID, -3, 2**40, 7, 8]
    assert np.diff(starts).tolist() == [len(d) for d in docs]
    with pytest.raises(IndexError):
        file.token(len(every))
    empty = tokens.TokenFile(io.BytesIO(tokens.encode_file([1], [b""])))
    assert empty.n_tokens == 0 and empty.tokens(0, 0).tolist() == []


def test_documents_come_back(spark, edges, no_docs, folder):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(PATH)
    manifest = tokens.write_tokens(edges, PATH, f"{folder}/tokens", file_tokens=50)
    assert manifest.count() > 1
    got = sorted(tokens.read_documents(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 7, 8, 9, 9, 10, 10]
    texts, at = {}, 0
    for r in edges.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        texts.setdefault(r["doc_id"], []).append(
            (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert (r["n_tokens"], r["ids_crc32"]) in texts[r["doc_id"]] and r["start"] == at
        at += r["n_tokens"]
    assert tokens.tokenized(spark, no_docs, PATH).count() == 0


# ---- queries and pipeline

def test_each_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert normal(got) == normal(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, n, stage_docs = [], docs.count(), docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(stage(spark, stage_docs, SMALL), f"test-{name}")
        names.append(name)
        if i < 4:
            assert out.columns == docs.columns
        if i in (1, 2):
            assert 0 < out.count() < stage_docs.count()
        stage_docs = out
    assert names == ["language_id", "simhash_dedup", "decontamination", "mixing", "token_ids"]
    rows = stage_docs.collect()
    assert sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    assert n / 2 < len(rows) < 2 * n


def test_pipeline_on_odd_and_empty_documents(spark, edges, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "size"]
    for docs in (edges.select(columns), no_docs.select(columns)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SMALL), "test-odd")
        assert docs.count() >= 0
