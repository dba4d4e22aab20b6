"""Writing standardized tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CSV = {"header": "true", "escape": '"', "multiLine": "true"}


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header. Nested columns are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.mode(mode).options(**_CSV).csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    """What ``write_csv`` wrote; quoted line breaks survive."""
    return spark.read.schema(schema).options(**_CSV).csv(path)


def write_catalog(rows: DataFrame, types: DataFrame, path: str) -> None:
    """All standardized datasets at once, a folder for each dataset and method.

    ``rows`` is what ``apply_rows`` gives with typed values, ``types`` the types of its
    fields. Rows are dealt out by dataset and method, large ones to several tasks and
    small ones together, so that neither one task nor a crowd of files comes of it.
    """
    pair = ("dataset", "method")
    rows.hint("rebalance", *pair).write.partitionBy(*pair).parquet(f"{path}/rows")
    types.write.parquet(f"{path}/types")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a written catalog: ``(dataset, method, row_id, fields, error)``."""
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def read_dataset(spark: SparkSession, path: str, dataset: str, method: str) -> DataFrame:
    """One dataset of a written catalog as a typed table; reads its folder only."""
    own = (F.col("dataset") == dataset) & (F.col("method") == method)
    fields = spark.read.parquet(f"{path}/types").where(own).orderBy("pos").collect()

    def typed(field: str, dtype: str):
        value = F.try_element_at("fields", F.lit(field))
        if dtype == "VARIANT":
            return value
        kind = "STRING" if dtype == "VOID" else dtype.replace("OBJECT<", "STRUCT<")
        return F.try_variant_get(value, "$", kind)

    return read_catalog(spark, path).where(own).select(
        "row_id", *[typed(r["field"], r["dtype"]).alias(r["field"]) for r in fields])


def save_evaluation(path: str, standardized: DataFrame, truth: DataFrame) -> None:
    """The standardized rows and the expanded ground truth, for reading by eye."""
    write_csv(standardized, f"{path}/standardized", "overwrite")
    write_csv(truth, f"{path}/ground_truth", "overwrite")
