"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a tape of words: all its documents once, then as much of a second
copy as its target needs. A tape consists of blocks (hash ranges of documents) in a
permuted order. The blocks a source contributes are its quota. A binary tree
shares the quotas out among the output shards: at each node the left half gets a
multivariate-hypergeometric draw of the node's blocks, so every shard gets an
equal number of blocks and, in expectation, the target weights. Shards then take
disjoint stretches of each source's permuted blocks and shuffle their documents
locally by a hash.

The last block of a tape is cut at a document. Of the ``SIDE`` documents before the cut
and the ``SIDE`` after it, in the order of the tape, those are taken instead whose sizes
add up nearest to the target, out of all choices. So a source of up to ``SIDE`` documents
comes as near to its target as whole documents can, and a larger one within few words.

What the choice depends on is the table of sources. Documents are compared with
the cut of their source, so they are not shuffled; only the blocks in which a tape
ends are looked at document by document.

Cases: null text has size 0 and is taken like any other; null sources are one
source, the last; null ids are told apart by their text; rows equal in id, source
and text are taken together; a source without words has target 0 and its documents
are left out; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmap.llm.common import GAP, WORD, free_name, quoted, small
from colmap.session import written

#: hash ranges per source; also the most rows of a window over blocks
BLOCKS = 4096
WEIGHTS = (3, 1, 2)
#: documents on each side of a cut that may be exchanged
SIDE = 6


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    lead = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0)
    tail = F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    parts = F.size(F.split(text, GAP)) - lead - tail
    return F.when(text.rlike(WORD), parts).otherwise(0).cast("long")


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources stand in code point order, null last, and get the weights in turn.
    ``share`` of all words is shared out by weight; a source stops at ``cap`` times
    its size and the excess goes to the others by weight. Sources reach their cap
    in the order of size by weight, so the level at which the others stop follows
    from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn(
        "weight", F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.row_number().over(order) - 1) % len(weights) + 1))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.lit(cap) * F.col("source_size")
    return (
        listed
        .withColumn("words", F.sum("source_size").over(everything) * share)
        .withColumn("left", F.col("words") - F.coalesce(F.sum(capped).over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", capped * F.col("open") <= F.col("left") * F.col("weight"))
        # the level: what is left at the first source that does not reach its cap
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct(
            F.col("source_size") / F.col("weight"), F.col("left") / F.col("open")))
        ).over(everything)["col2"])
        .withColumn("target", F.when(F.col("full"), capped).otherwise(
            F.least(capped, F.col("level") * F.col("weight"))))
        .select("source", "source_size", "weight", "target")
    )


def _unit(*parts) -> Column:
    """A number from 0 to 1 that depends on ``parts`` only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, units) from (source_no, units), by recursive halving.

    One row is a node; its quotas are an array over sources. The draw for the left
    half goes through the node's blocks one by one and takes each with probability
    (places left) / (blocks left), source after source, which is the multivariate
    hypergeometric distribution.
    """
    nodes = quotas.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("source_no", "units"))).alias("quotas")
    ).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "quotas")

    def total(q):
        return F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x["units"])

    def draw(low, high, q, need):
        """Units of each source that go left."""

        def source(state, x):
            def block(t, i):
                u = _unit(F.lit(seed), low, high, x["source_no"], i)
                hit = F.when(u * t["all"] < t["need"], 1).otherwise(0).cast("long")
                return F.struct((t["all"] - 1).alias("all"), (t["need"] - hit).alias("need"),
                                (t["got"] + hit).alias("got"))

            steps = F.when(x["units"] > 0, F.sequence(F.lit(1).cast("long"), x["units"])
                           ).otherwise(F.array().cast("array<long>"))
            inner = F.aggregate(steps, F.struct(
                state["all"].alias("all"), state["need"].alias("need"),
                F.lit(0).cast("long").alias("got")), block)
            return F.element_at(F.transform(F.array(inner), lambda t: F.struct(
                t["all"].alias("all"), t["need"].alias("need"),
                F.concat(state["left"], F.array(t["got"])).alias("left"))), 1)

        start = F.struct(total(q).alias("all"), need.alias("need"),
                         F.array().cast("array<long>").alias("left"))
        return F.aggregate(q, start, source, lambda s: s["left"])

    width = 1
    while width < shards:
        width *= 2
        low, high, q = F.col("low"), F.col("high"), F.col("quotas")
        middle = F.floor((low + high) / 2).cast("int")
        need = F.round(total(q) * (middle - low) / (high - low)).cast("long")
        nodes = (
            nodes.withColumn("middle", middle)
            .withColumn("left", F.when(high - low > 1, draw(low, high, q, need)))
            .select(F.inline(F.when(high - low > 1, F.array(
                F.struct("low", F.col("middle").alias("high"), F.zip_with(
                    "quotas", "left", lambda x, n: F.struct(
                        x["source_no"].alias("source_no"), n.alias("units"))).alias("quotas")),
                F.struct(F.col("middle").alias("low"), "high", F.zip_with(
                    "quotas", "left", lambda x, n: F.struct(
                        x["source_no"].alias("source_no"),
                        (x["units"] - n).alias("units"))).alias("quotas")),
            )).otherwise(F.array(F.struct("low", "high", "quotas")))))
        )
    return nodes.select(F.col("low").alias("shard"), F.inline("quotas"))


def _nearest_choice(around: Column, missing: Column) -> Column:
    """Hashes of the documents in ``around`` whose sizes come nearest to what they shall fill.

    They shall fill ``missing`` words and those of the documents drawn among them. All
    choices are looked at, at most 2 to the power of 2 * ``SIDE``.
    """
    start = F.array(F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("mask")))
    listed = F.transform(around, lambda x, i: F.struct(
        x["h"].alias("h"), x["size"].alias("size"),
        F.call_function("shiftleft", F.lit(1), i).alias("bit")))
    need = missing + F.aggregate(around, F.lit(0).cast("long"), lambda s, x: s + F.when(
        x["drawn"], x["size"]).otherwise(0))

    def with_and_without(sums, x):
        return F.concat(sums, F.transform(sums, lambda t: F.struct(
            (t["sum"] + x["size"]).alias("sum"), (t["mask"] + x["bit"]).alias("mask"))))

    def best(sums):
        return F.array_min(F.zip_with(
            sums, F.array_repeat(need, F.size(sums)), lambda t, n: F.struct(
                F.abs(t["sum"] - n).alias("off"), t["mask"].alias("mask"))))["mask"]

    mask = F.aggregate(listed, start, with_and_without, best)
    # a fold over the one mask, so that it is not computed again for every document
    return F.aggregate(F.array(mask), F.array().cast("array<long>"), lambda _, m: F.transform(
        F.filter(listed, lambda x: x["bit"].bitwiseAND(m) != 0), lambda x: x["h"]))


def draws(
    docs: DataFrame,
    shards: int = 16,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with one struct column ``mix``.

    It holds size, source_size, target, copies (how often the document is taken),
    shards (of each copy) and place (a hash to order a shard by).
    """
    mix = free_name(docs, "mix")
    mark = F.struct(
        quoted(source_col).alias("source"), size_of(quoted(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), quoted(id_col), quoted(source_col), quoted(text_col)).alias("h"))
    block = F.shiftrightunsigned("h", 52).cast("int")
    marked = written(
        docs.select(F.inline(F.array(mark))).withColumn("block", block), "mix-sizes")

    sums = written(marked.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")),
                   weights, share, cap)
    wanted = F.round(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0,
                   F.floor(wanted / F.col("source_size"))).otherwise(0)
    plan = written(
        plan.withColumn("source_no", F.row_number().over(
            Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("whole", whole.cast("long"))
        .withColumn("rest", wanted - F.col("whole") * F.col("source_size")), "targets")
    n_sources = plan.count()

    # blocks of a tape in permuted order, up to the one in which it ends
    turn = F.xxhash64(F.lit(seed), F.col("source_no"), F.col("block"))
    along = Window.partitionBy("source_no").orderBy("turn", "block")
    tape = written(
        sums.join(small(plan.withColumnRenamed("source", "name"), n_sources),
                  F.col("source").eqNullSafe(F.col("name")))
        .select("source", "source_no", "whole", "rest", "block", "words", turn.alias("turn"))
        .withColumn("upto", F.sum("words").over(along))
        .withColumn("rank", F.row_number().over(along)), "tapes")
    ends = tape.where("upto > rest").groupBy("source_no").agg(
        F.min_by(F.struct("block", "rank", (F.col("rest") - F.col("upto") + F.col("words"))
                          .alias("room")), "rank").alias("end"))
    last = plan.join(ends, "source_no", "left").select(
        "*", F.col("end.block").alias("end_block"),
        F.col("end.rank").alias("end_rank"), F.col("end.room").alias("room")).drop("end")
    last = written(last, "tape-ends")

    # documents of the block in which the tape ends: those before the cut
    def lookup(columns: list[str]) -> DataFrame:
        return small(last.select(F.col("source").alias("name"), *columns), n_sources)

    def of_source(df: DataFrame, *columns: str) -> DataFrame:
        return df.join(lookup(list(columns)), F.col("source").eqNullSafe(F.col("name")))

    running = Window.partitionBy("source_no").orderBy("h")
    cuts = (
        of_source(marked, "source_no", "end_block", "room")
        .where("block = end_block")
        .withColumn("upto", F.sum("size").over(running)).where("upto <= room")
        .groupBy("source_no").agg(F.max("h").alias("cut"), F.max("upto").alias("used"))
    )
    last = written(last.join(cuts, "source_no", "left").withColumn(
        "missing", F.col("room") - F.coalesce("used", F.lit(0).cast("long"))), "cuts")

    # the documents on both sides of the cut, and the best choice of them
    n_blocks = tape.count()
    near = tape.select("source_no", F.col("source").alias("of"), F.col("block").alias("in_block"),
                       "rank").join(small(last.select(
                           "source_no", "end_rank", "cut", "missing", "rest"), n_sources), "source_no")
    near = near.where((F.abs(F.col("rank") - F.col("end_rank")) <= SIDE) & (F.col("rest") > 0))
    drawn = F.coalesce((F.col("rank") < F.col("end_rank")) | (
        (F.col("rank") == F.col("end_rank")) & (F.col("h") <= F.col("cut"))), F.lit(False))
    outwards = Window.partitionBy("source_no", "drawn").orderBy(
        F.when(F.col("drawn"), -F.col("rank")).otherwise(F.col("rank")),
        F.when(F.col("drawn"), F.bitwise_not("h")).otherwise(F.col("h")))
    around = (
        marked.where("size > 0").join(
            small(near, n_sources * (2 * SIDE + 1)),
            F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in_block")))
        # rows that share the hash come along together
        .groupBy("source_no", "missing", "rank", "h", drawn.alias("drawn"))
        .agg(F.sum("size").alias("size"))
        .withColumn("nth", F.row_number().over(outwards)).where(F.col("nth") <= SIDE)
        .groupBy("source_no", "missing").agg(F.array_sort(F.collect_list(
            F.struct("drawn", "nth", "h", "size"))).alias("around"))
    )
    last = written(
        last.join(around.select(
            "source_no", F.transform("around", lambda x: x["h"]).alias("open"),
            _nearest_choice(F.col("around"), F.col("missing")).alias("picked")),
            "source_no", "left"), "fills")

    # units: a copy of a block; the quota of a source is how many units it gives
    units = written(
        tape.join(small(last.select("source_no", "end_rank"), n_sources), "source_no")
        .where("rest + whole > 0")
        .withColumn("copies", F.col("whole") + F.when(
            F.col("rank") <= F.col("end_rank"), 1).otherwise(0))
        .where("copies > 0")
        .select("source", "source_no", "block", F.explode(
            F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .withColumn("place", F.row_number().over(Window.partitionBy("source_no").orderBy(
            F.xxhash64(F.lit(seed), F.lit("draw"), "source_no", "block", "copy"),
            "block", "copy"))), "units")
    tree = split_tree(units.groupBy("source_no").agg(F.count(F.lit(1)).alias("units")),
                      shards, seed)
    to = F.sum("units").over(Window.partitionBy("source_no").orderBy("shard"))
    stretches = written(
        tree.withColumn("to", to).withColumn("above", F.col("to") - F.col("units"))
        .where("units > 0").select("source_no", "shard", "above", "to"), "stretches")
    placed = (
        units.join(small(stretches, n_sources * shards), "source_no")
        .where("place > above and place <= to")
        .groupBy(F.col("source").alias("of"), F.col("block").alias("in_block"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))),
                         lambda x: x["shard"]).alias("unit_shards"))
    )
    placed = written(placed, "unit-shards")
    ranks = tape.select(F.col("source").alias("of"), F.col("block").alias("in_block"), "rank").join(
        placed.withColumnsRenamed({"of": "o", "in_block": "b"}),
        F.col("of").eqNullSafe(F.col("o")) & (F.col("in_block") == F.col("b")), "left").drop("o", "b")

    chosen = (F.col("rest") > 0) & F.when(
        F.array_contains("open", F.col("h")), F.array_contains("picked", F.col("h"))
    ).otherwise(drawn)
    copies = F.col("whole") + chosen.cast("long")
    own = F.slice(F.coalesce("unit_shards", F.array().cast("array<int>")), F.lit(1),
                  copies.cast("int"))
    # the block of a document behind the cut has one unit less than the document has copies
    spare = F.pmod(F.xxhash64(F.lit(seed), F.lit("fill"), "h"), F.lit(shards)).cast("int")
    own = F.concat(own, F.array_repeat(spare, (copies - F.size(own)).cast("int")))
    kept = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("doc"), mark.alias("m"))
    kept = kept.select("doc", "m.*").withColumn("block", block)
    found = of_source(
        kept, "source_size", "target", "whole", "rest", "end_rank", "cut", "open", "picked",
    ).join(small(ranks, n_blocks),
           F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in_block")))
    return found.select("doc.*", F.struct(
        "size", "source_size", "target", copies.alias("copies"), own.alias("shards"),
        F.xxhash64(F.lit(seed), F.lit("place"), "h").alias("place")).alias(mix))


def mixed(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """``docs`` in the mix: a row for every copy taken, and none for the rest.

    Two columns are added, ``shard`` and ``place``; ``arranged`` puts the rows there.
    """
    found = draws(docs, shards, **options)
    mix = quoted(found.columns[-1])
    names = [free_name(docs, "shard"), free_name(docs, "place")]
    return found.select(
        *[quoted(c) for c in docs.columns], F.posexplode(mix["shards"]).alias("copy_", names[0]),
        mix["place"].alias(names[1])).withColumn(
            names[1], F.xxhash64(names[1], "copy_")).drop("copy_")


def arranged(rows: DataFrame, slices: int = 1) -> DataFrame:
    """Rows of ``mixed`` by shard, each shard (or slice of one) in shuffled order."""
    shard, place = (quoted(c) for c in rows.columns[-2:])
    return rows.repartition(shard, F.pmod(place, F.lit(slices))).sortWithinPartitions(shard, place)
