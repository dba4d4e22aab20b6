"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # long texts go to Python workers in batches of bounded size
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def configure(builder):
    """Add the recommended settings to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="colmap-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the folder all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/colmap-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, so neither a lost executor nor a second reader runs the
    work above it again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
