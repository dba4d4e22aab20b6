"""Importance resampling towards the word statistics of target texts.

Texts are read as UTF-8 bytes: a table of 256 bytes puts A-Z in lower case and blanks
everything that is neither a letter, a digit nor part of a character beyond ASCII, and
``bytes.split`` gives the words. A feature is a run of one to ``longest`` consecutive
words joined by one space; its bucket is the CRC-32 of that text modulo ``buckets``,
which is chained: the sum of a longer run starts from that of the run before its last
word. The gain of a bucket is the log ratio of its shares in the target and in the raw
texts, both with one feature more in every bucket, in thousandths and rounded down. A
document weighs the sum of the gains of its features. Adding Gumbel noise by the hash
of doc_id and keeping the highest scores draws without replacement by weight.

Counting reduces each group of texts with a Counter, each task to at most ``buckets``
rows and Spark these to one row per bucket: the gains are the only thing that goes to
the driver and to the workers, and their number is a parameter. Ranks come from a
distributed sort: ranges of scores are numbered inside and moved by the counts of the
ranges before them, so no task sees more than its range.

Cases: null, empty and blank texts have no features, weight 0 and no rank; texts are
read whole; a null doc_id has the noise of the empty text and comes last among ties;
rows that share score and doc_id are ordered by the hash of their text, and equal rows
count one by one; without targets all gains follow from the raw texts alone; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmap.llm.common import quoted
from colmap.session import written

#: texts are counted in groups of about so many characters
GROUP_CHARS = 1 << 20
WEIGHED = "struct<n_words long, n_features long, weight long>"

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: lower case for A-Z, a blank for what separates words
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def feature_sums(words: list[bytes], longest: int) -> Iterator[Iterator[int]]:
    """CRC-32 of all runs of one word, of two words, and so on."""
    sums = list(map(crc32, words))
    yield sums
    spaced = [b" " + w for w in words] if longest > 1 else []
    for n in range(2, longest + 1):
        sums = list(map(crc32, spaced[n - 1:], sums))
        yield sums


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    group, held = [], 0
    for text in texts.to_pylist():
        group.append(text)
        held += len(text or "")
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def bucket_counts(docs: DataFrame, longest: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without any are missing."""

    def count(batches):
        found = Counter()
        for batch in batches:
            for group in _groups(batch.column("text")):
                if longest == 1:
                    seen = Counter(chain.from_iterable(map(split_words, group)))
                    for word, n in seen.items():
                        found[crc32(word) % buckets] += n
                    continue
                seen = Counter()
                for text in group:
                    for sums in feature_sums(split_words(text), longest):
                        seen.update(sums)
                for crc, n in seen.items():
                    found[crc % buckets] += n
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(list(found), pa.int32()),
            "n": pa.array(list(found.values()), pa.int64())})

    return (
        docs.select(quoted(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    )


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket from the counts of raw and target texts."""
    s, t = [0] * buckets, [0] * buckets
    for counts, table in ((s, raw), (t, target)):
        for row in table.collect():  # one row per bucket at most
            counts[row["bucket"]] = row["n"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((float(b + 1) * all_s) / (float(a + 1) * all_t)))
            for a, b in zip(s, t, strict=True)]


def weighed(text: Column, gain: list[int], longest: int) -> Column:
    """(n_words, n_features, weight) of each text."""
    table = np.array(gain, np.int64)

    @F.arrow_udf(WEIGHED)
    def weigh(texts: pa.Array) -> pa.Array:
        n_words, n_features, weights = [], [], []
        for group in _groups(texts):
            for words in map(split_words, group):
                features = weight = 0
                for sums in feature_sums(words, longest):
                    at = np.fromiter(sums, np.int64, len(sums)) % len(table)
                    weight += int(table[at].sum())
                    features += len(sums)
                n_words.append(len(words))
                n_features.append(features)
                weights.append(weight)
        return pa.StructArray.from_arrays(
            [pa.array(v, pa.int64()) for v in (n_words, n_features, weights)],
            ["n_words", "n_features", "weight"])

    return weigh(text)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document in thousandths, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000,
    percent: int = 10, min_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """Draw ``percent`` of the documents of ``min_words`` words or more.

    One row (doc_id, n_features, weight, score, rank) per document; ``rank`` counts
    the drawn ones from 1 and is null for the others.
    """
    gain = gains(bucket_counts(docs, longest, buckets, text_col),
                 bucket_counts(target, longest, buckets, target_text), buckets)
    doc_id = quoted(id_col)
    scored = docs.select(
        doc_id.alias("doc_id"), F.xxhash64(quoted(text_col)).alias("tie"),
        weighed(quoted(text_col), gain, longest).alias("w"),
    ).select(
        "doc_id", "tie", "w.n_features", "w.weight",
        (F.col("w.weight") + noise(F.col("doc_id"), seed)).alias("score"),
        (F.col("w.n_words") >= min_words).alias("can"))
    order = [F.desc("can"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    ranged = written(
        scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "scores")
    counts = ranged.where("can").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per range
    offsets = counts.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    drawn = ranged.where("can").count() * percent // 100
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    return ranged.join(
        F.broadcast(offsets), (F.col("part") == F.col("p")) & F.col("can"), "left",
    ).withColumn("number", number).select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("can") & (F.col("number") <= drawn), F.col("number")).cast("long")
        .alias("rank"))
