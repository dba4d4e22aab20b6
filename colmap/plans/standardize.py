"""Standardizing one dataset, or a whole catalog in one plan."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import catalog_task, quoted, union_all
from colmap.operators.apply import apply_mapping, apply_rows, mapping_plans, plan_types
from colmap.operators.prompts import samples
from colmap.operators.schema import as_rows, catalog, column_types, columns_of_rows, head
from colmap.operators.scores import presence_scores, table_presence
from colmap.operators.truth import column_places, seen_columns
from colmap.plans.methods import Method, embedding_method, keyword_method, model_method
from colmap.session import written
from colmap.sources.sinks import write_catalog
from colmap.sources.splits import load_split

_ONE = "dataset"


def standardize_catalog(rows: DataFrame, method: Method) -> DataFrame:
    """Mappings for all schemaless datasets in ``rows`` ``(dataset, row_id, row)``:
    ``(dataset, method, entries, task, status, code, score, catalog_task)``."""
    top = head(rows)
    proposals = method(columns_of_rows(top), samples(top))
    return presence_scores(proposals, top).withColumn(
        "catalog_task", catalog_task(F.col("task"))
    )


def row_plans(rows: DataFrame, method: Method) -> DataFrame:
    """The mapping plans that a method makes for all schemaless datasets, written."""
    top = head(rows)
    columns = columns_of_rows(top)
    proposals = written(method(columns, samples(top)), "proposals")
    return written(mapping_plans(proposals, seen_columns(column_places(rows))), "plans")


def standardize_rows(rows: DataFrame, method: Method, typed: bool = False) -> DataFrame:
    """All rows of all schemaless datasets in standard form:
    ``(dataset, method, row_id, fields, error)``; see ``apply_rows``."""
    return apply_rows(rows, row_plans(rows, method), typed)


def save_catalog(rows: DataFrame, method: Method, path: str) -> None:
    """Standardize all schemaless datasets and write them, types kept; see ``read_dataset``."""
    plans = row_plans(rows, method)
    write_catalog(apply_rows(rows, plans, typed=True), plan_types(plans, column_types(rows)), path)


def sample_rows(df: DataFrame, order: list[str] | None, n: int) -> DataFrame:
    """First rows of one typed table in the form ``samples`` has."""
    picked = (df.orderBy(*[quoted(c) for c in order]) if order else df).limit(n)
    packed = as_rows(picked, _ONE, df.columns[0])
    return packed.agg(F.collect_list("row").alias("sample")).select(
        F.lit(_ONE).alias("dataset"), "sample"
    )


def propose(df: DataFrame, method: Method, order: list[str] | None = None) -> dict:
    """A method's mapping for one typed table, as a dict, with its rename plan."""
    if not df.columns:
        return {"mapping": {}, "code": vocab.NO_FEATURES}
    columns = catalog(df.sparkSession, {_ONE: df})
    row = method(columns, sample_rows(df, order, vocab.PROMPT_ROWS)).first()
    if row is None:
        return {"mapping": {}, "code": vocab.NO_FEATURES}
    return {
        "mapping": {e["field"]: json.loads(e["value_json"]) for e in row["entries"]},
        "code": row["code"],
    }


def standardize(
    df: DataFrame, method: Method, order: list[str] | None = None, scored: bool = True
) -> dict:
    """``mapping``, ``code`` and ``score`` of a table, the table itself as
    ``dataset`` and its lazy standardized form as ``standardized``."""
    found = propose(df, method, order)
    score = table_presence(df, found["mapping"]) if scored else 0.0
    return {
        **found,
        "score": score,
        "dataset": df,
        "standardized": apply_mapping(df, found["mapping"]),
    }


def load_standardized_dataset(
    spark: SparkSession, root: str, name: str, config: str | None = None,
    instruction: str | None = None, model_id: str = "", *, factory, backend: str = "api",
    order: list[str] | None = None, **how,
) -> dict:
    """Open a dataset and standardize it with a model behind ``factory``."""
    df = load_split(spark, root, name, config, **how)
    return standardize(df, model_method(factory, backend, model_id, instruction), order)


def load_standardized_dataset_local(spark: SparkSession, root: str, name: str, *args, **kwargs):
    """The same with the prompt and reply rules of a local model."""
    return load_standardized_dataset(spark, root, name, *args, backend="local", **kwargs)


def _opened(spark, dataset, config, root, how) -> DataFrame:
    return load_split(spark, root, dataset, config, **how) if isinstance(dataset, str) else dataset


def baseline_keyword_match(
    spark: SparkSession, dataset: DataFrame | str, config: str | None = None,
    root: str = ".", **how,
) -> dict:
    """Synonym lookup for a table or a dataset name; its score is always 0.0."""
    return standardize(_opened(spark, dataset, config, root, how), keyword_method(), scored=False)


def baseline_embedding_match(
    spark: SparkSession, dataset: DataFrame | str, config: str | None = None,
    threshold: float = vocab.SIMILARITY_THRESHOLD, *, encoder, root: str = ".", **how,
) -> dict:
    """Vector similarity for a table or a dataset name; its score is always 0.0."""
    df = _opened(spark, dataset, config, root, how)
    return standardize(df, embedding_method(encoder, threshold), scored=False)


def standardize_tables(
    spark: SparkSession, frames: Mapping[str, DataFrame], method: Method
) -> DataFrame:
    """Proposals for many typed tables in one plan; schemas only, unless the
    method reads samples."""
    columns = catalog(spark, frames)
    parts = [
        sample_rows(df, None, vocab.PROMPT_ROWS).withColumn("dataset", F.lit(name))
        for name, df in frames.items()
    ]
    return method(columns, union_all(parts))
