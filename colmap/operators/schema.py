"""Column lists of datasets, and their values in long form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmap.functions import vocab
from colmap.functions.exprs import (
    column_key,
    exact_form,
    exact_names,
    first_rows,
    quoted,
    strict_json,
    union_all,
)
from colmap.session import written

COLUMNS_SCHEMA = "dataset string, pos int, col string, dtype string"

# type names of values in schemaless rows
_ROW_TYPES = [
    ("BIGINT", "int"),
    ("STRING", "str"),
    ("BOOLEAN", "bool"),
    ("DOUBLE", "float"),
    ("FLOAT", "float"),
    ("DECIMAL", "float"),
    ("ARRAY", "list"),
    ("OBJECT", "dict"),
    ("VOID", "NoneType"),
]


def catalog(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """``columns`` of typed datasets, straight from their schemas; reads no rows.

    A dataset without columns has one line, with no column on it.
    """
    lines = []
    for name, df in frames.items():
        fields = [
            (name, pos, field.name, field.dataType.simpleString())
            for pos, field in enumerate(df.schema.fields)
        ]
        lines += fields or [(name, None, None, None)]
    return spark.createDataFrame(lines, COLUMNS_SCHEMA)


def as_rows(df: DataFrame, dataset: str, order: str) -> DataFrame:
    """A typed table in the form of a schemaless one: ``(dataset, row_id, row)``."""
    source, name_in = exact_names(df)
    fields = [F.col(quoted(name_in[c])).alias(c) for c in df.columns]
    return source.select(
        F.lit(dataset).alias("dataset"),
        F.col(quoted(name_in[order])).alias("row_id"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("row"),
    )


def catalog_rows(frames: Mapping[str, DataFrame], orders: Mapping[str, str]) -> DataFrame:
    """Typed tables as one table of schemaless rows; ``orders`` names the column
    that orders each, by default its first."""
    return union_all(
        as_rows(df, name, orders.get(name, df.columns[0])) for name, df in frames.items()
    )


def head(rows: DataFrame, n: int = vocab.SCORE_ROWS) -> DataFrame:
    """The first ``n`` rows of every schemaless dataset, written once.

    Schemas, samples and presence scores need no others, so given this table
    instead of the whole one they share a single pass over the data.
    """
    kept = first_rows(rows.select("dataset", "row_id", "row"), "dataset", ["row_id"], n)
    return written(kept.drop("rn"), "head")


def columns_of_rows(rows: DataFrame, order: str = "row_id", row: str = "row") -> DataFrame:
    """``columns`` of schemaless datasets from the first row of each.

    ``rows`` is ``(dataset, <order>, <row>)`` with one JSON object per row. Keys
    keep the order they have in the text. A dataset whose first row has none has
    one line, with no column on it.
    """
    first = first_rows(rows.select("dataset", order, row), "dataset", [order], 1)
    keyed = first.select(
        "dataset",
        F.from_json(row, "map<string,variant>").alias("_values"),
        F.posexplode_outer(F.json_object_keys(row)).alias("pos", "col"),
    )
    return keyed.select(
        "dataset",
        "pos",
        "col",
        F.when(F.col("col").isNotNull(), _row_type(F.try_element_at("_values", F.col("col"))))
        .alias("dtype"),
    )


def column_types(rows: DataFrame, row: str = "row") -> DataFrame:
    """Columns of schemaless datasets from all of their rows: ``(dataset, pos, col, dtype)``.

    Columns come in order of first appearance. ``dtype`` is the type that all values of
    a column share, as SQL names it: VOID if all are null, VARIANT if they share none.
    Only types are shuffled, one per column and task; rows that are not one JSON object
    have no columns.
    """
    values = F.get(strict_json(F.col(row), T.MapType(T.StringType(), T.VariantType())), 0)
    cells = rows.select("dataset", "row_id", values.alias("m")).select(
        "dataset", "row_id", F.posexplode(F.map_entries("m")).alias("pos", "e"))
    found = cells.groupBy("dataset", F.col("e.key").alias("col")).agg(
        F.min(F.struct("row_id", "pos")).alias("place"),
        F.schema_of_variant_agg(F.coalesce("e.value", F.parse_json(F.lit("null")))).alias("dtype"))
    listed = found.groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct("place", "col", "dtype"))).alias("cols"))
    return listed.select("dataset", F.posexplode("cols").alias("pos", "c")).select(
        "dataset", "pos", "c.col", "c.dtype")


def _row_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    named = F.lit("NoneType")
    for prefix, name in _ROW_TYPES:
        named = F.when(kind.startswith(prefix), F.lit(name)).otherwise(named)
    return named


def column_sets(columns: DataFrame) -> DataFrame:
    """One row per dataset with its column names in order.

    The array is as long as one schema is wide.
    """
    known = F.when(F.col("col").isNotNull(), F.struct("pos", "col"))
    ordered = F.array_sort(F.collect_list(known))
    return columns.groupBy("dataset").agg(F.transform(ordered, lambda c: c["col"]).alias("cols"))


def cells(
    frames: Mapping[str, DataFrame], keyed: bool = False
) -> DataFrame:
    """Distinct non-null values of typed datasets as ``(dataset, col, pos, val)``.

    ``keyed`` gives values as keys of bounded size, which is all that comparing
    and counting need; long texts are then not shuffled. All datasets go through
    one distinct, on positions; names are put back after it.
    """
    lines = union_all(_stacked(df, i, keyed) for i, df in enumerate(frames.values()))
    names = F.array(
        *[
            F.struct(
                F.lit(name).alias("dataset"),
                F.array(*[F.lit(c) for c in df.columns]).alias("cols"),
            )
            for name, df in frames.items()
        ]
    )
    return (
        lines.where(F.col("val").isNotNull())
        .distinct()
        .select(F.get(names, "table").alias("at"), "pos", "val")
        .select("at.dataset", F.get("at.cols", "pos").alias("col"), "pos", "val")
    )


def _stacked(df: DataFrame, table: int, keyed: bool) -> DataFrame:
    """Every value of a table on a line of its own: ``(table, pos, val)``."""
    source, _ = exact_names(df)
    lines = []
    for pos, f in enumerate(source.schema.fields):
        value = exact_form(f.name, f.dataType)
        if keyed:
            value = column_key(f.name, f.dataType, exact_form)
        lines += [F.lit(pos), value]
    return source.select(
        F.lit(table).alias("table"),
        F.stack(F.lit(len(source.columns)), *lines).alias("pos", "val"),
    )


def value_counts(df: DataFrame, dataset: str) -> DataFrame:
    """Rows and non-null values per column, in one scan without a wide shuffle."""
    source, _ = exact_names(df)
    counted = source.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(quoted(c))).alias(f"_c{i}") for i, c in enumerate(source.columns)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(f.name).alias("col"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("_rows").alias("n_rows"),
                F.col(f"_c{i}").alias("n_values"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counted.select(F.lit(dataset).alias("dataset"), F.inline(lines))
