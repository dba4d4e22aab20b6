"""Raw model responses to mapping proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import ENTRIES, no_entries, rename_plan
from colmap.functions.json_text import entries_column

# reading mode of each backend's replies
MODES = {"api": "lenient", "local": "strict"}


def extract(responses: DataFrame, mode: str = "strict", raw: str = "raw") -> DataFrame:
    """``responses`` with ``entries``: the mapping in each reply, null if none.

    Row-local, so it works on a stream as well. Needs a JSON parser as strict as
    Python's, which ``from_json`` is not; hence one Arrow function. Replies
    without a brace hold no object and are not sent to it.
    """
    parse = F.arrow_udf(entries_column(mode), ENTRIES)
    text = F.when(F.contains(F.col(raw), F.lit("{")), F.col(raw))
    return responses.withColumn("entries", parse(text))


def parse_responses(responses: DataFrame, backend: str = "local") -> DataFrame:
    """Proposals from a ``responses`` table; unusable replies stay as failures."""
    parsed = extract(responses, MODES[backend])
    failed = F.col("entries").isNull()
    task = F.filter("entries", lambda e: e["field"] == "task")
    return parsed.select(
        "dataset",
        "method",
        F.coalesce("entries", no_entries()).alias("entries"),
        F.when(~failed, F.element_at(task, 1)["value"]).alias("task"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        F.when(failed, F.lit(vocab.INFER_FAILED[backend]))
        .otherwise(rename_plan(F.col("entries")))
        .alias("code"),
    )


def fill_missing(proposals: DataFrame, datasets: DataFrame, method: str) -> DataFrame:
    """Failure rows for datasets without any proposal: they had no columns."""
    absent = datasets.select("dataset").distinct().join(proposals, "dataset", "left_anti")
    return proposals.unionByName(
        absent.select(
            "dataset",
            F.lit(method).alias("method"),
            no_entries().alias("entries"),
            F.lit(None).cast("string").alias("task"),
            F.lit("failed").alias("status"),
            F.lit(vocab.NO_FEATURES).alias("code"),
        )
    )
