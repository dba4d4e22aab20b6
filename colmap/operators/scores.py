"""Scores of mappings. Inputs hold one row per (dataset, method) or per dataset,
so every score is a row expression after at most one join on ``dataset``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import (
    first_rows,
    half_even,
    jaccard,
    predicted_columns,
    text_array,
)


def all_columns_valid(entries: Column, cols: Column) -> Column:
    """Is every string value, the task aside, a raw column?"""
    known = F.coalesce(cols, text_array([]))
    return F.forall(
        entries,
        lambda e: (e["field"] == "task")
        | ~e["is_string"]
        | F.array_contains(known, F.coalesce(e["value"], F.lit(""))),
    )


def field_recall(truth_fields: Column, entries: Column) -> Column:
    """Share of ground-truth fields that the mapping has; 0.0 without any."""
    fields = F.array_distinct(truth_fields)
    predicted = F.filter(
        F.transform(entries, lambda e: e["field"]), lambda f: f != "task"
    )
    shared = F.size(F.array_intersect(fields, predicted))
    return F.when(F.size(fields) > 0, shared / F.size(fields)).otherwise(F.lit(0.0))


def struct_scores(proposals: DataFrame, truth: DataFrame) -> DataFrame:
    """Jaccard of predicted and ground-truth column sets, per (dataset, method).

    ``truth`` is ``(dataset, gt_cols)``. Datasets without ground truth give no
    row: an evaluation grid shows them as failed.
    """
    predicted = proposals.withColumn("pred_cols", F.array_sort(predicted_columns(F.col("entries"))))
    raw = jaccard(F.col("gt_cols"), F.col("pred_cols"))
    return predicted.join(truth.select("dataset", "gt_cols"), "dataset").withColumn(
        "score", half_even(raw)
    ).withColumn("struct_score", F.col("score"))


def key_rows(rows: DataFrame, n: int = vocab.SCORE_ROWS, order: str = "row_id") -> DataFrame:
    """Key lists of the first ``n`` rows of a dataset, in order of appearance and
    with the number of rows that have each: ``(dataset, shapes)``."""
    slim = rows.select(
        "dataset", order, F.to_json(F.json_object_keys("row")).alias("shape")
    )
    counted = (
        first_rows(slim, "dataset", [order], n)
        .groupBy("dataset", "shape")
        .agg(F.min("rn").alias("rn"), F.count(F.lit(1)).alias("n"))
        .select("dataset", "rn", "n", F.from_json("shape", "array<string>").alias("keys"))
    )
    return counted.groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct("rn", "n", "keys"))).alias("shapes")
    )


def presence(entries: Column, shapes: Column, n: int = vocab.SCORE_ROWS) -> Column:
    """Share of ``n`` rows that have every mapped column.

    Only values that are columns of the first row are required, and the divisor
    is ``n`` even when there are fewer rows.
    """
    first = F.get(shapes, 0)["keys"]
    refs = F.transform(
        F.filter(
            entries,
            lambda e: (e["field"] != "task") & e["is_string"]
            & F.array_contains(first, e["value"]),
        ),
        lambda e: e["value"],
    )
    full = F.filter(shapes, lambda s: F.size(F.array_except(refs, s["keys"])) == 0)
    rows = F.aggregate(full, F.lit(0).cast("long"), lambda total, s: total + s["n"])
    return F.when((F.size(entries) <= 0) | shapes.isNull(), F.lit(0.0)).otherwise(rows / n)


def presence_scores(
    proposals: DataFrame, rows: DataFrame, n: int = vocab.SCORE_ROWS
) -> DataFrame:
    """Proposals with their presence score over schemaless rows."""
    return (
        proposals.join(key_rows(rows, n), "dataset", "left")
        .withColumn("score", presence(F.col("entries"), F.col("shapes"), n))
        .drop("shapes")
    )


def table_presence(df: DataFrame, mapping: dict, n: int = vocab.SCORE_ROWS) -> float:
    """Presence score of one typed table, where every row has every column."""
    return df.limit(n).count() / n if mapping else 0.0
