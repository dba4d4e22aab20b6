"""Lists of datasets to work on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmap.functions import vocab


def fixed_registry(spark: SparkSession) -> DataFrame:
    """The fixed set of datasets: ``(card_id, name, config)``."""
    return spark.createDataFrame(
        vocab.DATASET_REGISTRY, "card_id string, name string, config string"
    )


def discover_tasks(tasks: DataFrame, task_types: Iterable[str] = ("Classification",)) -> DataFrame:
    """Entries of a task table of the wanted types:
    ``(id, name, config, task_type, spec)``; a NaN config is null."""
    config = F.col("config_name")
    if isinstance(tasks.schema["config_name"].dataType, (T.DoubleType, T.FloatType)):
        config = F.when(~F.isnan(config), config)
    return tasks.where(F.col("task_type").isin(*task_types)).select(
        "id",
        F.col("dataset_name").alias("name"),
        config.cast("string").alias("config"),
        "task_type",
        F.col("mapping").alias("spec"),
    )


def dataset_id(name, config):
    """``name/config``, or the name alone."""
    return F.concat_ws("/", name, config)


def seeded_sample(
    datasets: DataFrame,
    key: str,
    n: int = vocab.SAMPLE_SIZE,
    seed: int = vocab.SAMPLE_SEED,
) -> DataFrame:
    """At most ``n`` datasets, the same ones for a seed however data is laid out."""
    place = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    return datasets.orderBy(place, key).limit(n)
