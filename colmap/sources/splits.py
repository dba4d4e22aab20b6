"""Opening datasets from files by name, config and split.

A dataset lies under ``<root>/<name>``. Its files are either

* ``<config>/<split>`` or ``<split>``: a folder, or files ``<split>.<format>`` and
  ``<split>-*.<format>``; or
* not split at all: ``<root>/<name>.<format>``, or files right in the folder. Such
  data counts as its ``train`` split.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmap.functions import vocab
from colmap.functions.exprs import exact_order


#: formats whose files say themselves whether they can be read
CHECKED = ("parquet", "orc")


def _open(spark: SparkSession, path: str, fmt: str, schema, options: dict) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema is None:
        return reader.load(path)
    if fmt in CHECKED:
        reader.load(path)  # reads a footer, which a given schema would leave out
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


class Files:
    """Path probing by a reader of files; looks at names only, never at contents.

    Listing is the reader's, so it runs on any file system Spark knows, in parallel
    where there are many folders, and needs no access to the driver's JVM.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def below(self, pattern: str) -> DataFrame | None:
        """The files at or below what matches, as ``path``; None if nothing does."""
        try:
            return self._spark.read.format("binaryFile").option(
                "recursiveFileLookup", True).load(pattern).select("path")
        except AnalysisException:
            return None

    def matches(self, pattern: str) -> bool:
        return self.below(pattern) is not None

    def folders(self, path: str) -> list[str]:
        """Names of the folders in ``path`` that hold files; one row each reaches the driver."""
        found = self.below(path)
        if found is None:
            return []
        parts = F.split(below_folder(F.col("path"), path), "/")
        return sorted(r[0] for r in found.where(F.size(parts) > 1).select(
            F.get(parts, 0)).distinct().collect())


def below_folder(path: Column, folder: str) -> Column:
    """The part of a file's path that is below ``folder``, given with or without scheme."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/")
    return F.get(F.split(path, re.escape(plain) + "/", 2), 1)


def _candidates(base: str, split: str, fmt: str) -> list[str]:
    return [f"{base}/{split}", f"{base}/{split}.{fmt}", f"{base}/{split}-*.{fmt}"]


def _unsplit(files: Files, base: str, fmt: str) -> list[str]:
    """Places of data that belongs to no split."""
    named = [p for split in vocab.SPLITS for p in _candidates(base, split, fmt)]
    inside = [] if any(files.matches(p) for p in named) else [f"{base}/*.{fmt}"]
    return [f"{base}.{fmt}", *inside]


def load_split(
    spark: SparkSession,
    root: str,
    name: str,
    config: str | None = None,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """The first of the splits train, test, validation that opens.

    Without a config the dataset's own files are tried first; when it has only
    configs, the first one by name is taken for every split.
    """
    files = Files(spark)
    base = f"{root.rstrip('/')}/{name}"
    bases = [f"{base}/{config}"] if config else [base]
    if not config:
        configs = [f for f in files.folders(base)
                   if f not in vocab.SPLITS and f[0] not in "._" and not f.endswith(f".{fmt}")]
        bases += [f"{base}/{configs[0]}"] if configs else []
    last = None
    for split in vocab.SPLITS:
        places = [p for b in bases for p in _candidates(b, split, fmt)]
        if split == "train":
            places += [p for b in bases for p in _unsplit(files, b, fmt)]
        for place in places:
            if not files.matches(place):
                continue
            try:
                return _open(spark, place, fmt, schema, options)
            except Exception as exc:  # unreadable files are no split
                last = exc
    raise ValueError(f"No accessible split for {name}/{config}: {last or 'no files'}")


def load_rows(
    spark: SparkSession, root: str, name: str, config: str | None = None,
    limit: int | None = None, order: list[str] | None = None, **how,
) -> DataFrame:
    """Like ``load_split``, with the first ``limit`` rows where that is asked for.

    They are the first by ``order``, or by the first column: files have no order.
    """
    df = load_split(spark, root, name, config, **how)
    if limit is None or not df.columns:
        return df
    return df.orderBy(*exact_order(order or df.columns[:1])).limit(limit)


def raw_columns(
    spark: SparkSession, root: str, name: str, config: str | None = None, **how
) -> set[str]:
    """Column names of a dataset from its schema alone; empty if it does not open."""
    try:
        return set(load_split(spark, root, name, config, **how).columns)
    except ValueError:
        return set()
