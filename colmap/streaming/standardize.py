"""Standardizing and response parsing on streams.

Both are row-local, so the batch functions take a streaming table as it is; many
datasets at once, and cards, are handled batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from colmap.operators.apply import apply_mapping, apply_rows
from colmap.operators.responses import extract
from colmap.sources.cards import discover


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options):
    """Files that arrive under ``path`` as a stream."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def standardize_stream(stream: DataFrame, mapping: Mapping) -> DataFrame:
    return apply_mapping(stream, mapping)


def standardize_catalog_stream(
    rows: DataFrame, plans: DataFrame, path: str, checkpoint: str, available_now: bool = True
):
    """Standardize rows of many datasets as they arrive, each by the plans of its dataset.

    ``rows`` is a stream of ``(dataset, row_id, row)``, ``plans`` a table
    (``mapping_plans``) that every batch is joined with. A batch is written under its
    number, so one that runs again after a failure takes the place of its first try.
    """

    def keep(batch: DataFrame, number: int) -> None:
        apply_rows(batch, plans).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def discover_stream(
    cards: DataFrame, path: str, checkpoint: str, task_types: Iterable[str] | None = None,
    available_now: bool = True,
):
    """``discover`` over card files as they arrive: the first card of an id stays.

    ``cards`` is a stream of ``(catalog_pos, path, body)``. Cards that an earlier batch
    has are left out of a later one; within a batch the first by place counts.
    """

    def keep(batch: DataFrame, number: int) -> None:
        found = discover(batch, task_types)
        if number:
            before = batch.sparkSession.read.parquet(
                *[f"{path}/batch={n}" for n in range(number)]).select("card_id")
            found = found.join(before, "card_id", "left_anti")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = cards.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def extract_stream(stream: DataFrame, mode: str = "strict", raw: str = "raw") -> DataFrame:
    return extract(stream, mode, raw)


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True
):
    """Append a stream to files, each input row once; the checkpoint folder lets
    a restarted query go on where it stopped."""
    writer = (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
