"""A Bloom filter of keys as a table: which keys are certainly not among others.

A key has one bit among 2**26, in words of 64. The words that have bits are at most
2**20 rows of two numbers, 16 MB, however many keys there are; so they may always be
sent to every task. A key that was put in is always found again; of others, a share as
large as that of the bits that are set is kept, so an exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 6
WORDS = 1 << 20


def _place(keys: list[str]) -> tuple[Column, Column]:
    """The word of a key, and its bit in it."""
    h = F.xxhash64(*keys)
    bit = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit((1 << WORD_BITS) - 1).cast("long"))
    return h.bitwiseAND(F.lit(WORDS - 1).cast("long")), bit.cast("int")


def key_bits(df: DataFrame, *keys: str) -> DataFrame:
    """The filter of the keys of ``df``: ``(_word, _bits)``."""
    word, bit = _place(list(keys))
    return df.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))


def perhaps_in(df: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``df`` whose key may be in the filter, before anything is shuffled."""
    word, bit = _place(list(keys))
    near = df.withColumn("_at", word).withColumn("_bit", bit)
    known = (F.col("_at") == F.col("_word")) & F.expr("(_bits & shiftleft(1L, _bit)) <> 0")
    return near.join(F.broadcast(bits), known, "left_semi").drop("_at", "_bit")
