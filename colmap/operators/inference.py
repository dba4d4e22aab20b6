"""The model call: prompts in, raw responses out, each paid for once."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmap.functions.exprs import quoted
from colmap.session import written

# Tasks carry these functions with them, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORED = "digest string, raw string, error string, at timestamp"


def cached_model(model_id: str, factory: Callable[[str], Callable]) -> Callable:
    """The model a worker process already holds for this id, or a new one."""
    held = sys.modules.setdefault("_colmap_models", types.ModuleType("_colmap_models")).__dict__
    key = f"{factory.__module__}.{getattr(factory, '__qualname__', '')} {model_id}"
    if key not in held:
        held[key] = factory(model_id)
    return held[key]


def _replies(model: Callable, prompts: list[dict]) -> list[tuple[str | None, str | None]]:
    """(raw, error) of each prompt; a model with a ``batch`` method gets them at once.

    If a batch fails, its prompts are asked one by one, so that one bad prompt costs
    no other its answer.
    """
    batch = getattr(model, "batch", None)
    if batch is not None and len(prompts) > 1:
        try:
            raws = list(batch(prompts))
            if len(raws) == len(prompts):
                return [(raw, None) for raw in raws]
        except Exception:
            pass
    found = []
    for prompt in prompts:
        try:
            raw = batch([prompt])[0] if batch is not None else model(prompt)
            found.append((raw, None))
        except Exception as exc:
            found.append((None, f"{type(exc).__name__}: {exc}"))
    return found


def _answer(factory: Callable[[str], Callable], size: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), size):
                part = frame.iloc[at:at + size]
                replies = {}
                for model_id, asked in part.groupby("model_id", dropna=False, sort=False):
                    prompts = asked.to_dict("records")
                    try:
                        found = _replies(cached_model(model_id, factory), prompts)
                    except Exception as exc:
                        found = [(None, f"{type(exc).__name__}: {exc}")] * len(prompts)
                    replies |= dict(zip(asked["digest"], found, strict=True))
                listed = [replies[d] for d in part["digest"]]
                yield part[["digest"]].assign(
                    raw=[r for r, _ in listed], error=[e for _, e in listed],
                    at=pd.Timestamp.now(tz="UTC"))

    return run


def infer(
    prompts: DataFrame,
    factory: Callable[[str], Callable],
    path: str,
    parallelism: int | None = None,
    batch: int = 16,
) -> DataFrame:
    """Send every prompt to a model; ``(dataset, method, backend, raw, error)`` of each.

    ``factory(model_id)`` builds a model in a worker; the model takes a prompt as
    a dict and returns text, or has a method ``batch`` that takes up to ``batch``
    prompts and returns a list of texts. An exception becomes the row's ``error``.
    Responses are written at ``path`` before anything reads them. They are known by a
    digest of the whole prompt with its model, so a run at the same path sends what
    is new or changed and what failed before, and returns only what it was asked.
    """
    spark = prompts.sparkSession
    asked = _with_digest(prompts)
    try:
        done = spark.read.schema(STORED).parquet(path).where("error is null")
        todo = asked.join(done.select("digest").distinct(), "digest", "left_anti")
    except AnalysisException:
        todo = asked
    # a fixed number of tasks, so that few small prompts do not end up in one
    tasks = parallelism or spark.sparkContext.defaultParallelism
    todo.dropDuplicates(["digest"]).repartition(tasks, "digest").mapInPandas(
        _answer(factory, batch), STORED
    ).write.mode("append").parquet(path)
    return _answered(asked, spark.read.schema(STORED).parquet(path))


def _with_digest(prompts: DataFrame) -> DataFrame:
    """Prompts with a digest of each, written."""
    return written(prompts.withColumn("digest", F.sha2(F.to_json(
        F.struct(*[F.col(quoted(c)) for c in prompts.columns])), 256)), "prompts")


def _answered(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """Prompts with the best reply to each: one without error, then the latest."""
    best = replies.groupBy("digest").agg(F.max_by(
        F.struct("raw", "error"), F.struct(F.col("error").isNull(), "at")).alias("r"))
    return asked.join(best, "digest").select("dataset", "method", "backend", "r.raw", "r.error")


def infer_in_waves(
    prompts: DataFrame,
    factory: Callable[[str], Callable],
    path: str,
    wave: int = 10_000,
    parallelism: int | None = None,
    batch: int = 16,
) -> DataFrame:
    """``infer`` by waves of about ``wave`` prompts, each of which is kept once it is done.

    Prompts are queued as files under ``path`` and read from there as a stream, a file
    at a time. A wave's replies are written under its number and then committed to the
    stream's checkpoint, so a job that dies loses the replies of one wave at most: the
    next run at the same path goes on with that wave, and its replies take the place of
    those that were written in part. A run queues what is new or failed before.
    """
    spark = prompts.sparkSession
    queue, replies = f"{path}/queue", f"{path}/replies"
    asked = _with_digest(prompts)
    todo = asked
    queued, stored = _stored(spark, queue, asked.schema), _stored(spark, replies, STORED)
    if queued is not None:
        waiting = queued.select("digest").distinct()
        if stored is not None:
            done = stored.where("error is null").select("digest").distinct()
            # what was tried in vain may be queued again
            tried = stored.select("digest").distinct().join(done, "digest", "left_anti")
            waiting = waiting.join(tried, "digest", "left_anti")
        todo = asked.join(waiting, "digest", "left_anti")
    files = -(-todo.select("digest").distinct().count() // wave)
    if files:
        todo.dropDuplicates(["digest"]).repartition(files, "digest").write.option(
            "maxRecordsPerFile", wave).mode("append").parquet(queue)
    tasks = parallelism or spark.sparkContext.defaultParallelism

    def ask(part: DataFrame, number: int) -> None:
        part.repartition(tasks, "digest").mapInPandas(_answer(factory, batch), STORED).write.mode(
            "overwrite").parquet(f"{replies}/wave={number}")

    if files or queued is not None:
        (spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(queue)
         .writeStream.foreachBatch(ask).option("checkpointLocation", f"{path}/progress")
         .trigger(availableNow=True).start().awaitTermination())
    return _answered(asked, _stored(spark, replies, STORED))


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None
