"""Ground truth declared by a spec: canonical field -> raw column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import ENTRIES, entries_from_json, text_array


def spec_entries(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Specs given as JSON objects, with their fields as entries."""
    return specs.withColumn("entries", entries_from_json(F.col(column)))


def declared(entries: Column, cols: Column) -> Column:
    """The entries of a spec that say something about a dataset.

    A value other than the field's default is a statement; a default one only if
    a raw column has that name, so it never counts when ``cols`` is null. All
    ``choice…`` fields count. Known fields come first, in their fixed order.
    """

    def stated(field: str, default: str) -> Column:
        present = F.coalesce(F.array_contains(cols, default), F.lit(False))
        return F.filter(
            entries,
            lambda e: (e["field"] == field) & e["is_string"] & ((e["value"] != default) | present),
        )

    known = [stated(field, default) for field, default in vocab.SPEC_DEFAULTS.items()]
    choices = F.filter(
        entries, lambda e: e["field"].startswith(vocab.SPEC_CHOICE_PREFIX) & e["is_string"]
    )
    return F.concat(*known, choices).cast(ENTRIES)


def spec_truth(specs: DataFrame, column_sets: DataFrame | None = None) -> DataFrame:
    """``(dataset, …, truth, gt_cols, structure)`` per spec row.

    Without ``column_sets`` the raw columns are unknown. Columns of ``specs``
    other than ``entries`` stay.
    """
    if column_sets is None:
        joined = specs.withColumn("cols", F.lit(None).cast("array<string>"))
    else:
        joined = specs.join(column_sets, "dataset", "left")
    return (
        joined.withColumn("truth", declared(F.col("entries"), F.col("cols")))
        .drop("entries")
        .withColumn("gt_cols", F.array_sort(F.array_distinct(F.col("truth.value"))))
        .withColumn(
            "structure",
            F.when(F.array_contains(F.col("truth.field"), vocab.SPEC_PAIR_FIELD), F.lit("paired"))
            .otherwise(F.lit("single")),
        )
    )


def inspection(truth: DataFrame, n: int | None = None, order: str = "id") -> DataFrame:
    """Readable listing of spec ground truth, the first ``n`` by ``order``:
    ``(id, type, truth, raw_columns)``."""
    pairs = F.transform("truth", lambda e: F.concat(e["field"], F.lit("←"), e["value"]))
    names = F.coalesce(F.array_sort("cols"), text_array([]))
    listing = truth.select(
        "id",
        F.concat_ws("/", "task_type", "structure").alias("type"),
        F.array_join(pairs, "  ").alias("truth"),
        F.when(F.size(names) == 0, F.lit("(unavailable)"))
        .otherwise(F.concat(F.lit("{"), F.array_join(names, ", "), F.lit("}")))
        .alias("raw_columns"),
    ).orderBy(order)
    return listing if n is None else listing.limit(n)
