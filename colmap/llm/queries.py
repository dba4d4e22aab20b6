"""Registered queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colmap.llm import (
    chat,
    decontam,
    html,
    importance,
    langid,
    mixing,
    periodic,
    pieces,
    pii,
    search,
    sharding,
    simhash,
    tokens,
)
from colmap.llm.common import words


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(
        F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = langid.fit(docs, ~held_out & F.col("doc_id").isNotNull())
    return docs.select(
        "doc_id", held_out.alias("held_out"), langid.predict(F.col("text"), model).alias("found"),
    ).select("doc_id", "held_out", "found.*")


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, max_bits=3)
    return found.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    found = mixing.draws(table(spark, sf, "documents"), shards=16)
    mix = F.col("mix")
    return found.select(
        "doc_id", mix["size"].alias("size"), mix["source_size"].alias("source_size"),
        mix["target"].alias("target"), (mix["size"] * mix["copies"]).alias("taken"),
        mix["shards"].alias("shards"))


def op10_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokens.tokenized(spark, table(spark, sf, "documents"), path)


def op3_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    rows = chat.with_conflict(table(spark, sf, "conversations"))
    return chat.digest(chat.formatted(rows))


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded(table(spark, sf, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf, "documents")))


def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(table(spark, sf, "pages"))


def op7_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query, against all documents."""
    docs = table(spark, sf, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, asked, k=10)


def op11_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = table(spark, sf, "documents").select(
        "doc_id", pieces.encoded(F.col("text"), path).alias("found"))
    ids = F.col("found.ids")
    return found.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("found.decoded"), 256).alias("decoded_sha256"))


def _repeating(doc_id: Column, listed: Column) -> Column:
    """Words of every tenth document, by the hash of its id, made to repeat."""
    h, n = F.crc32(doc_id.cast("string")), F.size(listed)
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    place = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when(
        i < a, i).otherwise(a + F.pmod(i - a, p)))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.transform(
        place, lambda i: F.get(listed, i.cast("int")))).otherwise(listed)


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    listed = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("words"))
    found = listed.select("doc_id", periodic.runs(
        _repeating(F.col("doc_id"), F.col("words"))).alias("found"))
    runs = F.col("found.runs")
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", periodic.strongest(runs)).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed"), 256).alias("collapsed_sha256"))


def op13_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_mixing": op4_mixing,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_search": op7_search,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_token_ids": op10_token_ids,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance": op13_importance,
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": chat.ORACLE,
    "op7_search": search.ORACLE,
    "op9_decontamination": decontam.ORACLE,
}
