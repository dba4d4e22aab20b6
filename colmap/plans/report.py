"""Tables of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import half_even, quoted


def present_methods(results: DataFrame) -> list[str]:
    """Methods of a result table in report order; further ones follow by name."""
    found = {r["method"] for r in results.select("method").distinct().collect()}
    known = [m for m in vocab.METHOD_ORDER if m in found]
    return known + sorted(found - set(known))


def score_pivot(
    results: DataFrame, score: str = "score", methods: Sequence[str] | None = None
) -> DataFrame:
    """Datasets × methods, not rounded. A pair that occurs twice is an error."""
    methods = list(methods or present_methods(results))
    twice = F.concat(F.lit("duplicate result for "), F.col("dataset"))
    cells = [
        F.when(
            F.count_if(F.col("method") == m) > 1, F.raise_error(twice).cast("double")
        ).otherwise(F.max(F.when(F.col("method") == m, F.col(score)))).alias(m)
        for m in methods
    ]
    return results.groupBy("dataset").agg(*cells)


def method_average(
    results: DataFrame, score: str = "score", methods: Sequence[str] | None = None
) -> DataFrame:
    """Mean score per method over datasets, failures left out:
    ``(method, score)``."""
    kept = results if methods is None else results.where(F.col("method").isin(*methods))
    return kept.groupBy("method").agg(half_even(F.avg(score)).alias("score"))


def score_table(
    results: DataFrame, score: str = "score", methods: Sequence[str] | None = None
) -> DataFrame:
    """The pivot with its ``Average`` row, rounded to three digits.

    Grouping sets give the scores of the pairs and the mean of each method from one
    pass over the results; the pivot then turns both at once.
    """
    methods = list(methods or present_methods(results))
    pair = [F.col("dataset"), F.col("method")]
    cells = results.where(F.col("method").isin(*methods)).groupingSets([pair, pair[1:]], *pair).agg(
        F.grouping_id().alias("level"), F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))
    twice = F.concat(F.lit("duplicate result for "), F.col("dataset"))
    one = F.when((F.col("level") == 0) & (F.col("n") > 1), F.raise_error(twice).cast("double")
                 ).otherwise(F.col("mean"))
    named = F.when(F.col("level") == 0, F.col("dataset")).otherwise(F.lit(vocab.AVERAGE))
    return cells.select("level", named.alias("dataset"), "method", one.alias("score")).groupBy(
        "level", "dataset").agg(*[
            half_even(F.max(F.when(F.col("method") == m, F.col("score")))).alias(m)
            for m in methods]).drop("level")


def show_scores(results: DataFrame, score: str = "score") -> None:
    """Print the score table, datasets by name and the average last."""
    table = score_table(results, score)
    ordered = table.orderBy(F.col("dataset") == vocab.AVERAGE, "dataset")
    ordered.show(max(1, table.count()), truncate=False)
