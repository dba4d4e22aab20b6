"""Sharding by a k-d tree over document metadata.

All documents are one node with all shards. A node with several shards is cut in
two along its widest metadata dimension, at the weighted median: the point with the
left half's share of the node's bytes before it. Dimensions are the source and
language (placed by a hash), the logarithm of the size and the id; each is scaled
to the extent it has over all documents, so widths can be compared.

Medians are found by histograms over bytes, never by sorting a node: first over
ranges of the dimension, then, within the range that holds the median, over hashes
of the text, of the id and of the row, until what is undecided weighs little.
Equal texts have the coordinates of one of them and equal hashes, so they stay in one
shard unless the median falls among them and they weigh over ``TOLERANCE`` of a
shard. A value that a third of all rows share is thus split like any other.

A cut can leave half a document too much on a side, which counts in small nodes and adds
up over the levels. So after each cut single documents without copies change sides, the
ones nearest in size to what a side lacks, until it lacks less than ``EVEN`` of a shard
or no document brings it nearer.

Places in a shard are numbered by ranges of a hash, with sums over the ranges in
front, so no task numbers a whole shard.

Cases: null text has no bytes and the checksum of no bytes; null sources, languages
and ids are values of their own, at the low end; repeated rows are told apart by
their row number; fewer documents than shards leave shards empty; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmap.llm.common import free_name, quoted, small
from colmap.session import written

BINS = 4096
#: hash ranges in which the places of a shard are numbered
CHUNKS = 1024
#: part of a shard's bytes that a cut may leave undecided
TOLERANCE = 0.01
#: part of a shard's bytes that may stay on the wrong side of a cut, and moves to get there
EVEN = 0.002
MOVES = 4
DIMENSIONS = ("source", "lang", "size", "id")
DEPTHS = ("bin", "by_text", "by_id", "by_row")


def _hash_bin(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - BINS.bit_length() + 1).cast("int")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text, and 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def described(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", row_col: str | None = None,
) -> DataFrame:
    """One row of metadata per document, written once; texts are not kept.

    Equal texts get the coordinates of one of them.
    """
    text, doc_id = quoted(text_col), quoted(id_col)

    def placed(value: Column) -> Column:
        return F.coalesce((F.crc32(value.cast("string")) + 1) / F.lit(float(1 << 32)), F.lit(0.0))

    row = quoted(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(
        row.alias("row"), doc_id.alias("doc_id"), size_of(text).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        F.array(placed(quoted(source_col)), placed(quoted(lang_col)),
                F.log2(size_of(text).cast("double")),
                F.coalesce(doc_id.cast("double"), F.lit(0.0))).alias("at"),
        F.xxhash64(text).alias("text"), _hash_bin(text).alias("by_text"), _hash_bin(doc_id, F.lit("id")).alias("by_id"))
    rows = written(rows.withColumn("by_row", _hash_bin("row", F.lit("row"))), "shard-rows")
    copies = (
        rows.groupBy(F.col("text").alias("same"))
        .agg(F.min("at").alias("common"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return written(
        rows.join(copies, F.col("text") == F.col("same"), "left")
        .withColumn("alone", F.col("common").isNull())
        .withColumn("at", F.coalesce("common", "at")).drop("text", "same", "common"),
        "shard-points")


def _extents(rows: DataFrame, *keys: str) -> DataFrame:
    n = len(DIMENSIONS)
    at = F.col("at")
    return rows.groupBy(*keys).agg(
        F.sum("size").alias("bytes"),
        *[F.min(at[i]).alias(f"low{i}") for i in range(n)],
        *[F.max(at[i]).alias(f"high{i}") for i in range(n)],
    ).select(*keys, "bytes", F.array(*[F.col(f"low{i}") for i in range(n)]).alias("low"),
             F.array(*[F.col(f"high{i}") for i in range(n)]).alias("high"))


def _cuts(rows: DataFrame, spans: list[float], nodes: int) -> DataFrame:
    """(node, dim, low, step, cut): rows of a node below ``cut`` go left."""
    whole = F.array(*[F.lit(x) for x in spans])[F.col("i")]
    width = F.when(whole > 0, (F.col("high")[F.col("i")] - F.col("low")[F.col("i")]) / whole
                   ).otherwise(0.0)
    goals = (
        _extents(rows, "node", "shards")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(DIMENSIONS) - 1))))
        .groupBy("node", "shards", "bytes").agg(F.max(F.struct(
            width.alias("width"), (-F.col("i")).alias("i"),
            F.col("low")[F.col("i")].alias("low"),
            ((F.col("high")[F.col("i")] - F.col("low")[F.col("i")]) / BINS).alias("step"))
        ).alias("w"))
        .select(
            "node", (-F.col("w.i")).alias("dim"), F.col("w.low").alias("low"),
            F.col("w.step").alias("step"),
            (F.col("bytes") * F.floor(F.col("shards") / 2) / F.col("shards")).alias("goal"),
            (F.col("bytes") / F.col("shards") * TOLERANCE).alias("slack"))
    )
    state = written(goals.withColumns({
        "cut": F.array().cast("array<int>"), "open": F.lit(True)}), "shard-goals")
    for depth, key in enumerate(DEPTHS):
        pending = small(state.where("open"), nodes)
        inside = binned(rows.join(pending, "node"))
        for d in range(depth):
            inside = inside.where(F.col(DEPTHS[d]) == F.get("cut", F.lit(d)))
        along = Window.partitionBy("node").orderBy("value")
        crossing = (
            inside.groupBy("node", F.col(key).alias("value"), "goal")
            .agg(F.sum("size").alias("weight"))
            .withColumn("upto", F.sum("weight").over(along)).where("upto > goal")
            .groupBy("node").agg(F.min(F.struct("value", "upto", "weight")).alias("c"))
        )
        last = depth == len(DEPTHS) - 1
        done = (F.col("c.weight") <= F.col("slack")) | F.lit(last)
        before = F.col("goal") - F.col("c.upto") + F.col("c.weight")
        # the undecided rows go to the side that is nearer to its share
        value = F.col("c.value") + F.when(done & (before * 2 > F.col("c.weight")), 1).otherwise(0)
        state = written(
            state.join(small(crossing, nodes), "node", "left").select(
                "node", "dim", "low", "step", "slack",
                F.when(F.col("open") & F.col("c").isNotNull(), before)
                .otherwise(F.col("goal")).alias("goal"),
                F.when(~F.col("open"), F.col("cut"))
                .otherwise(F.concat("cut", F.array(F.coalesce(value, F.lit(BINS)))))
                .alias("cut"),
                (F.col("open") & F.col("c").isNotNull() & ~F.coalesce(done, F.lit(True)))
                .alias("open")), "shard-cuts")
    return state.select("node", "dim", "low", "step", "cut")


def binned(rows: DataFrame) -> DataFrame:
    """Rows joined with their node's cut, with the range of its dimension they are in."""
    value = F.get(F.col("at"), F.col("dim"))
    place = F.when(F.col("step") > 0, F.floor((value - F.col("low")) / F.col("step"))).otherwise(0)
    return rows.withColumn("bin", F.least(place, F.lit(BINS - 1)).cast("int"))


def _evened(split: DataFrame, nodes: int) -> DataFrame:
    """``split`` with single rows moved across the cuts; see above."""
    for _ in range(MOVES):
        sums = split.where("shards > 1").groupBy("node", "shards").agg(
            F.sum("size").alias("bytes"),
            F.sum(F.when(F.col("goes_left"), F.col("size")).otherwise(0)).alias("left_bytes"))
        lacking = written(
            sums.select("node", (F.col("bytes") * F.floor(F.col("shards") / 2) / F.col("shards")
                                 - F.col("left_bytes")).alias("off"),
                        (F.col("bytes") / F.col("shards") * EVEN).alias("enough"))
            .where(F.abs("off") > F.col("enough")), "shard-lacking")
        gap = F.abs(F.col("size") - F.abs("off"))
        moves = written(
            split.where("shards > 1 and alone").join(small(lacking, nodes), "node")
            .where((F.col("goes_left") == (F.col("off") < 0)) & (gap < F.abs("off")))
            .groupBy("node").agg(F.min(F.struct(gap.alias("gap"), "by_row", "row")).alias("m"))
            .select("node", F.col("m.row").alias("row"), F.lit(True).alias("moves")),
            "shard-moves")
        if moves.isEmpty():
            break
        split = written(
            split.join(small(moves, nodes), ["node", "row"], "left").withColumn(
                "goes_left", F.col("goes_left") != F.coalesce("moves", F.lit(False))).drop("moves"),
            "shard-split")
    return split


def assigned(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of ``described`` with ``shard``; one halving of all nodes per round."""
    whole = _extents(rows).first()  # one number per dimension
    spans = [h - a if h is not None else 0.0 for a, h in zip(whole["low"], whole["high"])]
    rows = rows.withColumns({"node": F.lit(0), "shards": F.lit(shards)})
    widest = shards
    while widest > 1:
        cuts = _cuts(rows.where("shards > 1"), spans, shards)
        left = F.floor(F.col("shards") / 2).cast("int")
        key = F.array(*[F.col(k) for k in DEPTHS])
        before = F.slice(key, F.lit(1), F.size("cut")) < F.col("cut")
        split = _evened(written(
            binned(rows.join(small(cuts, shards), "node", "left"))
            .withColumn("goes_left", before).select(*rows.columns, "goes_left"),
            "shard-split"), shards)
        # a node is named by its first shard
        rows = written(split.select(
            "row", "doc_id", "size", "text_crc32", "at", "alone", "by_text", "by_id", "by_row",
            F.when((F.col("shards") == 1) | F.col("goes_left"), F.col("node"))
            .otherwise(F.col("node") + left).alias("node"),
            F.when(F.col("shards") == 1, F.lit(1))
            .when(F.col("goes_left"), left).otherwise(F.col("shards") - left).alias("shards"),
        ), "shard-nodes")
        widest -= widest // 2
    return rows.withColumnRenamed("node", "shard").drop("shards")


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Rows with ``slot``: 0, 1, 2 … in each shard."""
    chunk = F.pmod(F.xxhash64("row", F.lit("slot")), F.lit(CHUNKS)).cast("int")
    rows = rows.withColumn("chunk", chunk)
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = written(
        rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"),
        "shard-offsets")
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row"))
    return (
        rows.withColumn("place", place)
        .join(small(offsets, shards * CHUNKS), ["shard", "chunk"])
        .withColumn("slot", F.col("offset") + F.col("place") - 1).drop("chunk", "place", "offset")
    )


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
            **columns) -> DataFrame:
    """(row, doc_id, size, text_crc32, shard, slot) of every document.

    Give the number of leaves, or the bytes that a leaf should have.
    """
    rows = described(docs, **columns)
    if shards is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, round(total / target_bytes))
    found = numbered(assigned(rows, shards), shards)
    return found.select("row", "doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int, slices: int = 1, **columns) -> None:
    """Write ``docs`` as Parquet, a folder per shard, in the order of ``slot``.

    Each shard goes to ``slices`` files of consecutive slots or fewer.
    """
    row = free_name(docs, "row_number")
    shard = free_name(docs, "shard")
    copy = written(docs.withColumn(row, F.monotonically_increasing_id()), "shard-copy")
    found = numbered(assigned(described(copy, row_col=row, **columns), shards), shards).select(
        F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(f"{row}_slot"))
    share = F.lit(-(-copy.count() // (shards * slices)) or 1)
    placed = copy.join(found, row)
    slot = quoted(f"{row}_slot")
    (
        placed.repartition(quoted(shard), F.floor(slot / share)).sortWithinPartitions(shard, slot)
        .select(*[quoted(c) for c in docs.columns], quoted(shard))
        .write.partitionBy(shard).parquet(path)
    )
