"""Mapping proposals from column names: synonym lookup and vector similarity.

Both return proposals, one row per dataset:
``(dataset, method, entries, task, status, code)``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import entries_of, listed_entries, rename_plan, task_of, text_array

# Tasks carry these functions with them, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def keyword_match(
    columns: DataFrame,
    synonyms: Mapping[str, Sequence[str]] = vocab.FIELD_SYNONYMS,
    method: str = "keyword",
) -> DataFrame:
    """Per field, the first column whose lower-cased name is one of its synonyms.

    One aggregate per dataset finds all fields; the word lists are literals in
    the plan, so there is no join.
    """
    name = F.lower("col")
    wide = columns.groupBy("dataset").agg(
        *[
            F.min_by("col", F.when(name.isin(*words), F.col("pos"))).alias(f"f{i}")
            for i, words in enumerate(synonyms.values())
        ]
    )
    pairs = [(field, F.col(f"f{i}")) for i, field in enumerate(synonyms)]
    return with_task(wide, pairs, method)


def with_task(wide: DataFrame, pairs, method: str) -> DataFrame:
    """Proposals from one chosen column per field, with the task they imply."""
    fields = F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(f)) for f, c in pairs]))
    entries = entries_of(pairs + [("task", F.col("task"))])
    return (
        wide.withColumn("task", task_of(fields))
        .select(
            "dataset",
            F.lit(method).alias("method"),
            entries.alias("entries"),
            "task",
            F.lit("ok").alias("status"),
        )
        .withColumn("code", rename_plan(F.col("entries")))
    )


def encode_names(
    columns: DataFrame, encoder: Callable[[list[str]], Sequence[Sequence[float]]]
) -> DataFrame:
    """``columns`` with a vector per name; distinct names are spread over the tasks
    and each is encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [np.asarray(v, dtype="float64") for v in encoder(list(batch["col"]))]
            yield batch.assign(embedding=vectors)

    tasks = columns.sparkSession.sparkContext.defaultParallelism
    vectors = (
        columns.where(F.col("col").isNotNull()).select("col").distinct()
        .repartition(tasks, "col").mapInPandas(run, "col string, embedding array<double>")
    )
    return columns.join(vectors, "col", "left").select(
        "dataset", "pos", "col", "dtype", "embedding")


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def nearest(vectors: Sequence[Sequence[float]]) -> Callable:
    """Turns columns with vectors into the best of each batch, dataset and field.

    One matrix product per batch; pairs of a column and a field are never rows.
    """
    fields = _unit(np.asarray(vectors, dtype="float64"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(batch.column("embedding").is_valid())
            if not part.num_rows:
                continue
            rows = np.asarray(part.column("embedding").flatten(), dtype="float64")
            sims = _unit(rows.reshape(part.num_rows, -1)) @ fields.T
            pos = part.column("pos").to_numpy(zero_copy_only=False)
            group, names = pd.factorize(part.column("dataset").to_pandas())
            order = np.lexsort((pos, group))
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            for at, end in zip(starts, [*starts[1:], len(order)], strict=True):
                own = order[at:end]  # by pos, so that the first of equals wins
                top = own[np.argmax(sims[own], axis=0)]
                n = len(fields)
                yield pa.RecordBatch.from_pydict({
                    "dataset": pa.array([names[group[own[0]]]] * n, pa.string()),
                    "fpos": pa.array(np.arange(n, dtype="int32")),
                    "pos": pa.array(pos[top].astype("int64")),
                    "col": part.column("col").take(pa.array(top)),
                    "sim": pa.array(sims[top, np.arange(n)]),
                })

    return best


def embedding_match(
    columns: DataFrame,
    fields: Mapping[str, Sequence[float]],
    threshold: float = vocab.SIMILARITY_THRESHOLD,
    method: str = "embedding",
) -> DataFrame:
    """Per field, the column whose vector is nearest by cosine, if near enough.

    ``columns`` is ``(dataset, pos, col, embedding)``. Every Arrow batch is one
    matrix product with the field vectors, of which the best column of each dataset
    and field is kept; one aggregate then finds the best over all batches. On a
    tie the first column wins. One column may serve several fields.
    """
    found = columns.select("dataset", "pos", "col", "embedding").mapInArrow(
        nearest(list(fields.values())),
        "dataset string, fpos int, pos long, col string, sim double")
    best = found.groupBy("dataset", "fpos").agg(F.max_by(
        F.struct("col", "sim"), F.struct("sim", -F.col("pos"))).alias("b"))
    names = text_array(fields)
    chosen = (
        best.where(F.col("b.sim") >= threshold).groupBy("dataset")
        .agg(F.array_sort(F.collect_list(F.struct("fpos", "b.col"))).alias("chosen"))
    )
    pair = "array<struct<field:string,value:string>>"
    pairs = F.transform("chosen", lambda c: F.struct(
        F.get(names, c["fpos"]).alias("field"), c["col"].alias("value")))
    listed = columns.select("dataset").distinct().join(chosen, "dataset", "left").withColumn(
        "pairs", F.coalesce(pairs, F.array().cast(pair)))
    task = F.struct(F.lit("task").alias("field"), F.col("task").alias("value"))
    return (
        listed.withColumn("task", task_of(F.transform("pairs", lambda p: p["field"])))
        .select(
            "dataset", F.lit(method).alias("method"),
            listed_entries(F.concat("pairs", F.array(task))).alias("entries"),
            "task", F.lit("ok").alias("status"))
        .withColumn("code", rename_plan(F.col("entries")))
    )
