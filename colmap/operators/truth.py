"""Ground-truth columns from reference records (``task_data``).

``matches`` tables are ``(dataset, field, pos, n_gt, col, hits)``: the raw column
that holds a field's values, or null with 0 hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmap.functions import vocab
from colmap.functions.exprs import (
    annotation_key,
    as_map,
    column_key,
    exact_names,
    exact_order,
    first_rows,
    is_data_key,
    quoted,
    strict_json,
    text_array,
    text_form,
    union_all,
    value_key,
)
from colmap.operators.bloom import key_bits, perhaps_in
from colmap.session import written

_MASK_BITS = 63
#: columns whose distinct values are found in one scan
SET_COLUMNS = 16


def with_json(df: DataFrame, column: str) -> DataFrame:
    """``df`` with records given as structs or maps turned into JSON text."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return df
    return df.withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))


def unreadable(text: Column) -> Column:
    """Is a record there that is not a JSON object?"""
    return text.isNotNull() & as_map(text).isNull()


def expand_task_data(
    df: DataFrame, order: str, column: str = "task_data", keys: Sequence[str] | None = None,
) -> DataFrame:
    """``task_data`` objects as one text column per key, metadata keys dropped.

    Columns come in order of first appearance, or are ``keys`` where given. Tables
    whose rows invent their own keys should stay in the long form of
    ``task_data_cells`` instead. Records that cannot be read have no values.
    """
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "struct<>")
    df = with_json(df, column)
    if keys is None:
        # one column each, so the driver has to know them all
        seen = first_seen(df, [], order, column).where(~F.col("key").isin(*vocab.METADATA_KEYS))
        keys = [r["key"] for r in seen.orderBy("place").collect()]
    return df.select(as_map(F.col(column)).alias("_m")).select(
        *[F.try_element_at("_m", F.lit(k)).alias(k) for k in keys]
    )


def task_data_cells(df: DataFrame, column: str = "task_data") -> DataFrame:
    """Every row of ``df`` once per key of its ``task_data``: ``field``, ``val``."""
    df = with_json(df, column)
    rest = [F.col(quoted(c)) for c in df.columns if c != column]
    return df.select(*rest, F.explode(as_map(F.col(column))).alias("field", "val")).where(
        ~F.col("field").isin(*vocab.METADATA_KEYS)
    )


def first_fields(gt: DataFrame, order: str = "row_id", column: str = "task_data") -> DataFrame:
    """Keys of each dataset's first record, metadata left out:
    ``(dataset, pos, field)``."""
    keys = with_json(gt, column).select(
        "dataset", order, object_keys(F.col(column)).alias("keys")
    )
    first = first_rows(keys, "dataset", [order], 1)
    listed = first.select("dataset", F.posexplode("keys").alias("pos", "field"))
    return listed.where(~F.col("field").isin(*vocab.METADATA_KEYS))


def object_keys(text: Column) -> Column:
    """Keys of a JSON object in order; null if the text is anything else."""
    return F.map_keys(as_map(text))


def needed(n_gt: Column) -> Column:
    """Hits that make a column a match: half of the field's values, rounded
    down, and at least one."""
    return F.greatest(F.lit(1), F.floor(n_gt / 2))


def overlap_records(
    raw: DataFrame, gt: DataFrame, n: int | None = vocab.OVERLAP_ROWS
) -> DataFrame:
    """Value-overlap matches for many schemaless datasets at once.

    ``raw`` is ``(dataset, row_id, row)`` and ``gt`` is
    ``(dataset, row_id, task_data)``, one JSON object per row; ``n`` limits both
    to their first rows, None takes all. Records that cannot be read have no values;
    ``unreadable_datasets`` names the datasets that have some.
    """
    raw, gt = with_json(raw, "row"), with_json(gt, "task_data")
    if n is not None:
        raw = written(first_rows(raw, "dataset", ["row_id"], n).drop("rn"), "first-rows")
        gt = first_rows(gt, "dataset", ["row_id"], n)
    return overlap_of(truth_cells(gt), raw)


def truth_cells(gt: DataFrame) -> DataFrame:
    """Every distinct value of reference records, written once:
    ``(dataset, field, key, place, bad)``.

    ``place`` is where a value first appears. A record without keys has a line
    without a field; ``bad`` marks those that cannot be read.
    """
    parsed = gt.select(
        "dataset", "row_id", as_map(F.col("task_data")).alias("m"),
        F.col("task_data").isNotNull().alias("given"))
    lines = parsed.select(
        "dataset", "row_id", (F.col("given") & F.col("m").isNull()).alias("bad"),
        F.posexplode_outer(F.map_entries("m")).alias("pos", "e"))
    return written(
        lines.select(
            "dataset", F.col("e.key").alias("field"), value_key(F.col("e.value")).alias("key"),
            F.struct("row_id", "pos").alias("place"), "bad")
        .groupBy("dataset", "field", "key")
        .agg(F.min("place").alias("place"), F.bool_or("bad").alias("bad")),
        "truth-cells")


def fields_of(cells: DataFrame) -> DataFrame:
    """Data fields of each dataset's first record, from ``truth_cells``:
    ``(dataset, pos, field)``."""
    first = cells.groupBy("dataset").agg(F.min("place.row_id").alias("first"))
    return (
        cells.join(first, "dataset").where("place.row_id = first and field is not null")
        .where(is_data_key(F.col("field")))
        .groupBy("dataset", "field").agg(F.min("place.pos").alias("pos"))
        .select("dataset", "pos", "field")
    )


def overlap_of(cells: DataFrame, raw: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Matches of ``truth_cells`` with the values of ``raw`` rows.

    Raw values meet a filter of the truth's values before anything else, so hardly any
    that do not occur in the truth are shuffled and counted.
    """
    truth = cells.where(is_data_key(F.col("field")) & F.col("key").isNotNull()).select(
        "dataset", "key", "field")
    sizes = truth.groupBy("dataset", "field").agg(F.count(F.lit(1)).alias("n_gt"))
    raw_cells = raw.select(
        "dataset", F.explode(as_map(F.col("row"))).alias("col", "val")
    ).select("dataset", value_key(F.col("val")).alias("key"), "col").where("key is not null")
    known = perhaps_in(raw_cells, key_bits(truth, "dataset", "key"), "dataset", "key").distinct()
    hits = known.join(truth, ["dataset", "key"]).groupBy("dataset", "field", "col").agg(
        F.count(F.lit(1)).alias("hits"))
    places = column_places(raw) if places is None else places
    best = (
        hits.join(sizes, ["dataset", "field"]).where(F.col("hits") >= needed(F.col("n_gt")))
        .join(places, ["dataset", "col"]).groupBy("dataset", "field")
        .agg(F.min(F.struct("place", "col", "hits")).alias("best"))
    )
    return (
        fields_of(cells).join(sizes, ["dataset", "field"], "left")
        .join(best, ["dataset", "field"], "left")
        .select(
            "dataset", "field", "pos", F.coalesce("n_gt", F.lit(0)).alias("n_gt"),
            F.col("best.col").alias("col"), F.coalesce("best.hits", F.lit(0)).alias("hits"))
    )


def seen_columns(places: DataFrame) -> DataFrame:
    """``(dataset, cols)``: all columns of a dataset by their first appearance."""
    return places.groupBy("dataset").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "col"))), lambda c: c["col"]).alias("cols"))


def unreadable_datasets(cells: DataFrame) -> DataFrame:
    """Datasets with a record that is not a JSON object, from ``truth_cells``."""
    return cells.where("bad").select("dataset").distinct()


def column_places(raw: DataFrame) -> DataFrame:
    """Where each column of schemaless rows first appears: ``(dataset, col, place)``."""
    return first_seen(raw, ["dataset"], "row_id", "row").withColumnRenamed("key", "col")


def first_seen(df: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """The row and position at which each key of JSON rows first appears:
    ``(*by, key, place)``.

    Rows mostly share their key list, so the lists are counted down to distinct
    ones before they are taken apart.
    """
    shapes = (
        df.select(*by, order, object_keys(F.col(column)).alias("shape"))
        .groupBy(*by, "shape")
        .agg(F.min(order).alias(order))
    )
    return (
        shapes.select(*by, order, F.posexplode("shape").alias("pos", "key"))
        .groupBy(*by, "key")
        .agg(F.min(F.struct(order, "pos")).alias("place"))
    )


def overlap_frames(
    raw: DataFrame,
    gt: DataFrame,
    dataset: str,
    n: int | None = vocab.OVERLAP_ROWS,
    raw_order: list[str] | None = None,
    gt_order: list[str] | None = None,
    column: str = "task_data",
) -> DataFrame:
    """Value-overlap matches of one typed table.

    The schema is known here, so each distinct value carries bit masks, of the raw
    columns and of the truth fields it occurs in. Raw values are counted down to the
    distinct ones of each column in its own type, then become text, and go on only if
    a filter of the truth's values lets them.
    """
    raw_order = raw_order or raw.columns[:1]
    gt_order = gt_order or gt.columns[:1]
    gt = with_json(gt, column)
    raw_order, gt_order = exact_order(raw_order), exact_order(gt_order)
    # the place first: sorting records makes each of them, where they are made from columns
    place = F.struct(*gt_order)
    least = gt.orderBy(*gt_order).limit(1).select(place).scalar()
    first = gt.where(place.eqNullSafe(least)).select(object_keys(F.col(column)).alias("k")).first()
    keys = [] if first is None else (first["k"] or [])
    fields = [
        (pos, k)
        for pos, k in enumerate(keys)
        if k not in vocab.METADATA_KEYS and not annotation_key(k)
    ]
    spark = raw.sparkSession
    schema = "dataset string, field string, pos int, n_gt bigint, col string, hits bigint"
    if not fields:
        return spark.createDataFrame([], schema)
    if n is not None:
        raw = raw.orderBy(*raw_order).limit(n)
        gt = gt.orderBy(*gt_order).limit(n)

    names = raw.columns
    raw, _ = exact_names(raw)
    raw_words, gt_words = _words(len(names)), _words(len(fields))
    # the fields are known, so records are parsed into these alone
    known = T.StructType([T.StructField(k, T.StringType()) for _, k in fields])
    gt = gt.select(F.inline(strict_json(F.col(column), known))).toDF(
        *[f"f{i}" for i in range(len(fields))])
    gt_side = [
        (value_key(F.col(f"f{i}")), _masks(i, gt_words)) for i in range(len(fields))
    ]
    raw_masks = [f"r{w}" for w in range(raw_words)]
    gt_masks = [f"g{w}" for w in range(gt_words)]

    def stacked(df: DataFrame, side: list) -> DataFrame:
        lines = [x for key, bits in side for x in (key, *bits)]
        return df.select(
            F.stack(F.lit(len(side)), *lines).alias("key", *gt_masks)
        ).where(F.col("key").isNotNull())

    truth = written(
        stacked(gt, gt_side).groupBy("key").agg(*[F.bit_or(m).alias(m) for m in gt_masks]),
        "truth-keys")
    known = perhaps_in(distinct_values(raw), key_bits(truth, "key"), "key")
    hits = known.select("key", *[
        F.when(F.floor(F.col("pos") / _MASK_BITS) == w, F.expr(
            f"shiftleft(1L, pos % {_MASK_BITS})")).otherwise(F.lit(0).cast("long")).alias(m)
        for w, m in enumerate(raw_masks)
    ]).groupBy("key").agg(*[F.bit_or(m).alias(m) for m in raw_masks])
    owners = F.array(
        *[F.when(_has("g", i), F.struct(F.lit(p).alias("pos"), F.lit(k).alias("field")))
          for i, (p, k) in enumerate(fields)]
    )
    counted = (
        truth.join(hits, "key", "left")
        .select(F.inline(F.array_compact(owners)), *raw_masks)
        .groupBy("pos", "field")
        .agg(
            F.count(F.lit(1)).alias("n_gt"),
            *[F.count_if(_has("r", i)).alias(f"h{i}") for i in range(len(names))],
        )
    )
    tried = F.array(
        *[F.struct(F.lit(c).alias("col"), F.col(f"h{i}").alias("hits"))
          for i, c in enumerate(names)]
    )
    found = counted.select(
        "pos",
        "n_gt",
        F.get(F.filter(tried, lambda t: t["hits"] >= needed(F.col("n_gt"))), 0).alias("best"),
    )
    wanted = spark.createDataFrame(fields, "pos int, field string")
    return wanted.join(found, "pos", "left").select(
        F.lit(dataset).alias("dataset"),
        "field",
        "pos",
        F.coalesce("n_gt", F.lit(0)).alias("n_gt"),
        F.col("best.col").alias("col"),
        F.coalesce("best.hits", F.lit(0)).alias("hits"),
    )


def _words(bits: int) -> int:
    return -(-bits // _MASK_BITS)


def _masks(bit: int, words: int) -> list[Column]:
    """Mask words with one bit set."""
    return [F.lit(1 << (bit % _MASK_BITS) if bit // _MASK_BITS == w else 0).cast("long")
            for w in range(words)]


def distinct_values(df: DataFrame) -> DataFrame:
    """Distinct values of each column as keys: ``(pos, key)``, nulls left out.

    Grouping sets find them in the columns' own types, in one scan for every
    ``SET_COLUMNS`` columns; only what is left is turned into text.
    """
    parts = []
    for at in range(0, len(df.columns), SET_COLUMNS):
        fields = df.schema.fields[at:at + SET_COLUMNS]
        short = (T.NumericType, T.BooleanType, T.DatetimeType)
        typed = df.select(*[
            (F.col(quoted(f.name)) if isinstance(f.dataType, short)
             else column_key(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)])
        names = typed.columns
        sets = typed.groupingSets([[F.col(c)] for c in names], *[F.col(c) for c in names]).agg(
            F.grouping_id().alias("g"))
        pos, key = F.lit(None).cast("int"), F.lit(None).cast("string")
        for i, f in enumerate(fields):
            # the bits of the columns that are not in a set
            own = F.col("g") == (1 << len(names)) - 1 - (1 << (len(names) - 1 - i))
            text = text_form(f"c{i}", f.dataType) if isinstance(f.dataType, short) else F.col(f"c{i}")
            pos, key = F.when(own, at + i).otherwise(pos), F.when(own, text).otherwise(key)
        parts.append(sets.select(pos.alias("pos"), key.alias("key")))
    return union_all(parts).where(F.col("key").isNotNull())


def _has(side: str, bit: int) -> Column:
    word = F.col(f"{side}{bit // _MASK_BITS}")
    return word.bitwiseAND(F.lit(1 << (bit % _MASK_BITS)).cast("long")) != 0


def with_name_fallback(matches: DataFrame, column_sets: DataFrame) -> DataFrame:
    """Fill fields that no values matched: first with the raw column of the same
    name; a label-like field otherwise takes the first label-like column."""
    labels = text_array(vocab.LABEL_NAMES)
    like = F.get(F.filter(labels, lambda name: F.array_contains("cols", name)), 0)
    by_name = F.when(F.array_contains("cols", F.col("field")), F.col("field")).when(
        F.col("field").isin(*vocab.LABEL_NAMES), like
    )
    return (
        matches.join(column_sets, "dataset", "left")
        .withColumn("how", F.when(F.col("col").isNotNull(), F.lit("values"))
                    .when(by_name.isNotNull(), F.lit("name")))
        .withColumn("col", F.coalesce("col", by_name))
        .drop("cols")
    )


def truth_columns(matches: DataFrame) -> DataFrame:
    """Sorted set of matched raw columns per dataset: ``(dataset, gt_cols)``."""
    return matches.groupBy("dataset").agg(
        F.array_sort(F.collect_set("col")).alias("gt_cols")
    )
