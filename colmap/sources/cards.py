"""Catalog cards: JSON files that name a dataset and its task."""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext, cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmap.functions import vocab
from colmap.functions.exprs import card_family, card_id, strict_json, union_all
from colmap.session import written
from colmap.sources.splits import below_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: card files in a folder that ``write_cards`` makes; one task writes it, one lists it
CARDS_A_FOLDER = 256
_TEXT = T.StringType()
CARD = T.StructType([
    T.StructField("__type__", _TEXT),
    T.StructField("loader", T.StructType([T.StructField(c, _TEXT) for c in (
        "__type__", "path", "name")])),
    T.StructField("task", _TEXT),
])


def write_cards(bodies: DataFrame, folder: str) -> int:
    """A JSON file in folders below ``folder`` for each text of the only column; their number.

    Spark's writers took 21 ms a file on a local disk in one task and 82 ms in each of eight;
    here the tasks write the files themselves. Without a scheme, ``folder``
    is on the file system of the scratch space. Rows are dealt and sorted, so a task that
    runs again writes the same files; names are new in each call. Nulls have none.
    """
    kept = written(bodies.toDF("body").where("body is not null"), "card-bodies")
    run = uuid.uuid4().hex
    scheme = r"[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    own = re.match(scheme, folder)
    place = (own or re.match(scheme, kept.inputFiles()[0]))[0]
    below = folder[own.end():] if own else folder

    def write(batches):
        part, n = TaskContext.get().partitionId(), 0
        files, root = pyarrow.fs.FileSystem.from_uri(f"{place}/")
        at = f"{root.rstrip('/')}{below.rstrip('/')}/{part:06d}"
        for batch in batches:
            for body in batch.column(0).to_pylist():
                if n == 0:
                    files.create_dir(at, recursive=True)
                with files.open_output_stream(f"{at}/card-{n:06d}-{run}.json") as out:
                    out.write(f"{body}\n".encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt = kept.repartition(max(1, math.ceil(kept.count() / CARDS_A_FOLDER)))
    return dealt.sortWithinPartitions("body").mapInArrow(write, "n long").agg(
        F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_cards(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Raw card files of all catalogs as ``(catalog_pos, path, body)``.

    ``path`` is relative to the catalog's ``cards`` folder; roots without one are
    left out.
    """
    parts = []
    for pos, root in enumerate(roots):
        folder = f"{root.rstrip('/')}/cards"
        try:  # lists the files, once
            found = spark.read.option("recursiveFileLookup", True).option(
                "pathGlobFilter", "*.json").text(folder, wholetext=True)
        except AnalysisException:
            continue
        # file paths are encoded as addresses; a plus sign stands for itself
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        parts.append(found.select(
            F.lit(pos).alias("catalog_pos"), below_folder(plain, folder).alias("path"),
            F.col("value").alias("body")))
    if not parts:
        return spark.createDataFrame([], "catalog_pos int, path string, body string")
    return union_all(parts)


def parse_cards(raw: DataFrame) -> DataFrame:
    """Card files as columns; unreadable files are left out."""
    return raw.select(
        "catalog_pos", "path", F.explode(strict_json(F.col("body"), CARD)).alias("card"),
    ).where(F.col("card").isNotNull()).select("catalog_pos", "path", "card.*")


def discover(raw: DataFrame, task_types: Iterable[str] | None = None) -> DataFrame:
    """Cards of the wanted task families, one per card id:
    ``(card_id, name, config, task_type)``.

    Copies of a card are settled by an aggregate, which drops most of them
    before the shuffle however many one card has.
    """
    kept = (
        parse_cards(raw)
        .where((F.col("__type__") == vocab.CARD_TYPE)
               & (F.col("loader.__type__") == vocab.CARD_LOADER_TYPE))
        .select(
            card_id(F.col("path")).alias("card_id"),
            F.struct("catalog_pos", "path").alias("place"),
            F.struct(
                F.col("loader.path").alias("name"),
                F.col("loader.name").alias("config"),
                card_family(F.col("task"), task_types).alias("task_type"),
            ).alias("card"),
        )
        .where(F.col("card.task_type").isNotNull())
    )
    return (
        kept.groupBy("card_id")
        .agg(F.min_by("card", "place").alias("card"))
        .select("card_id", "card.*")
    )
