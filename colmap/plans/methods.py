"""The methods an evaluation compares.

A method is ``(columns, samples) -> proposals``: all datasets in, one proposal
per dataset out. Any function of that form can join the registry.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import entries_from_json, no_entries, rename_plan, text_array
from colmap.operators.inference import infer
from colmap.operators.matching import embedding_match, encode_names, keyword_match
from colmap.operators.prompts import build_prompts
from colmap.operators.responses import fill_missing, parse_responses
from colmap.operators.schema import column_sets
from colmap.session import scratch_path

# Tasks carry these functions with them, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Method = Callable[[DataFrame, DataFrame], DataFrame]


def keyword_method() -> Method:
    return lambda columns, samples: keyword_match(columns)


def embedding_method(
    encoder: Callable[[list[str]], Sequence[Sequence[float]]],
    threshold: float = vocab.SIMILARITY_THRESHOLD,
    fields: Sequence[str] = tuple(vocab.STANDARD_FIELDS),
) -> Method:
    """Vector similarity with any encoder of name lists."""

    def run(columns: DataFrame, samples: DataFrame) -> DataFrame:
        vectors = dict(zip(fields, encoder(list(fields))))
        return embedding_match(encode_names(columns, encoder), vectors, threshold)

    return run


def model_method(
    factory: Callable[[str], Callable],
    backend: str = "api",
    model_id: str = "",
    instruction: str | None = None,
    name: str | None = None,
    path: str | None = None,
) -> Method:
    """A language model behind ``factory``; responses are kept at ``path``."""
    method = name or f"{backend}_llm"

    def run(columns: DataFrame, samples: DataFrame) -> DataFrame:
        prompts = build_prompts(columns, samples, backend, model_id, instruction, method)
        place = path or scratch_path(columns.sparkSession, f"responses-{method}")
        answered = parse_responses(infer(prompts, factory, place), backend)
        return fill_missing(answered, columns, method)

    return run


def function_method(
    fn: Callable[[list[str], list[dict]], Mapping], name: str, path: str | None = None
) -> Method:
    """Any Python function from column names and first rows to a mapping.

    It runs in the workers, once per dataset, and its answers are kept like
    those of a model. Where it raises, the proposal has the ``error``, and the pair of
    dataset and method no score; a model's failed reply is an empty mapping instead.
    """

    own_id = f"{name} {uuid.uuid4().hex}"  # workers must not mix up two functions

    def factory(model_id: str) -> Callable[[dict], str]:
        return lambda ask: json.dumps(
            dict(fn(json.loads(ask["system"]), [json.loads(r) for r in json.loads(ask["user"])]))
        )

    def run(columns: DataFrame, samples: DataFrame) -> DataFrame:
        names = column_sets(columns.where(F.col("col").isNotNull()))
        asked = names.join(samples, "dataset", "left").select(
            "dataset",
            F.lit(name).alias("method"),
            F.lit("local").alias("backend"),
            F.lit(own_id).alias("model_id"),
            F.to_json("cols").alias("system"),
            F.to_json(F.coalesce("sample", text_array([]))).alias("user"),
        )
        place = path or scratch_path(columns.sparkSession, f"responses-{name}")
        replies = infer(asked, factory, place)
        raised = replies.where("error is not null").select("dataset", "error")
        entries = F.when(F.col("raw").isNotNull(), entries_from_json(F.col("raw"))).otherwise(
            no_entries())
        task = F.get(F.filter("entries", lambda e: e["field"] == "task"), 0)["value"]
        found = replies.withColumn("entries", entries).select(
            "dataset", "method", "entries", task.alias("task"),
            F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
            rename_plan(F.col("entries")).alias("code"))
        return fill_missing(found, columns, name).join(raised, "dataset", "left")

    return run


def method_registry(
    encoder=None, api_factory=None, local_factory=None, extra: Mapping[str, Method] | None = None
) -> dict[str, Method]:
    """The standard methods that can run with what is given, in report order."""
    methods = {"keyword": keyword_method()}
    if encoder is not None:
        methods["embedding"] = embedding_method(encoder)
    if local_factory is not None:
        methods["local_llm"] = model_method(local_factory, "local")
    if api_factory is not None:
        methods["api_llm"] = model_method(api_factory, "api")
    return {**methods, **(extra or {})}
