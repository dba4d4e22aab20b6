"""Scoring mappings against ground truth: one pair, or datasets × methods."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import (
    entries_from_json,
    exact_order,
    first_rows,
    mapping_json,
    text_array,
    union_all,
)
from colmap.operators.apply import apply_mapping
from colmap.operators.matching import keyword_match
from colmap.operators.prompts import samples
from colmap.operators.schema import catalog, column_sets, columns_of_rows, head
from colmap.operators.scores import struct_scores
from colmap.operators.specs import spec_entries, spec_truth
from colmap.operators.truth import (
    expand_task_data,
    column_places,
    overlap_frames,
    overlap_of,
    seen_columns,
    truth_cells,
    truth_columns,
    unreadable,
    unreadable_datasets,
    with_json,
    with_name_fallback,
)
from colmap.plans.methods import Method
from colmap.plans.standardize import propose, sample_rows
from colmap.session import written
from colmap.sources.registry import dataset_id
from colmap.sources.sinks import save_evaluation
from colmap.sources.splits import load_split

_ONE = "dataset"


def score_mapping(
    spark: SparkSession, dataset: str, mapping: Mapping, truth: DataFrame | None
) -> dict:
    """``score``, ``gt_cols`` and ``pred_cols`` of one mapping given as a dict.

    ``truth`` is ``(dataset, gt_cols)``; without it, or without its row, nothing
    is expected.
    """
    found = spark.createDataFrame(
        [(dataset, json.dumps(dict(mapping), ensure_ascii=False))], "dataset string, mapping string"
    ).select("dataset", F.lit("one").alias("method"),
             entries_from_json(F.col("mapping")).alias("entries"))
    known = found.select("dataset")
    if truth is not None:
        known = known.join(truth, "dataset", "left")
    else:
        known = known.withColumn("gt_cols", F.lit(None).cast("array<string>"))
    filled = known.select("dataset", F.coalesce("gt_cols", text_array([])).alias("gt_cols"))
    return struct_scores(found, filled).first().asDict()


def evaluate(
    raw: DataFrame,
    gt: DataFrame,
    dataset: str,
    method: Method,
    order: list[str] | None = None,
    gt_order: list[str] | None = None,
    n: int | None = vocab.OVERLAP_ROWS,
    n_samples: int | None = vocab.EVAL_ROWS,
    save_dir: str | None = None,
) -> dict:
    """One table and one method against its reference records.

    ``gt`` has a ``task_data`` column. ``n`` rows take part in value matching and
    ``n_samples`` in the saved files; None stands for all rows in both.
    """
    order, gt_order = order or raw.columns[:1], gt_order or gt.columns[:1]
    found = propose(raw, method, order)
    mapping = found["mapping"]
    truth = None
    if "task_data" in gt.columns and not raw.isEmpty():
        matches = overlap_frames(raw, gt, dataset, n, order, gt_order)
        names = column_sets(catalog(raw.sparkSession, {dataset: raw}))
        truth = truth_columns(with_name_fallback(matches, names))
    scored = score_mapping(raw.sparkSession, dataset, mapping, truth)
    if n_samples is not None:
        raw = raw.orderBy(*exact_order(order)).limit(n_samples)
        gt = gt.orderBy(*exact_order(gt_order)).limit(n_samples)
    standardized = apply_mapping(raw, mapping)
    if save_dir:
        save_evaluation(save_dir, standardized, expand_task_data(gt, gt_order[0]))
    return {
        "dataset": dataset,
        "score": scored["score"],
        "struct_score": scored["struct_score"],
        "gt_cols": scored["gt_cols"],
        "pred_cols": scored["pred_cols"],
        "mapping": mapping,
        "code": found["code"],
        "standardized": standardized,
        "error": None,
    }


def evaluate_spec(
    raw: DataFrame,
    spec: Mapping,
    name: str,
    config: str | None,
    method: Method,
    n_samples: int | None = vocab.SPEC_EVAL_ROWS,
    order: list[str] | None = None,
) -> dict:
    """One table and one method against a declared spec."""
    order = order or raw.columns[:1]
    mapping = propose(raw, method, order)["mapping"]
    spark = raw.sparkSession
    stated = spark.createDataFrame(
        [(_ONE, json.dumps(dict(spec), ensure_ascii=False))], "dataset string, spec string"
    )
    truth = spec_truth(spec_entries(stated), column_sets(catalog(spark, {_ONE: raw})))
    scored = score_mapping(spark, _ONE, mapping, truth)
    rows = raw if n_samples is None else raw.orderBy(*exact_order(order)).limit(n_samples)
    return {
        "dataset": f"{name}/{config}" if config else name,
        "score": scored["score"],
        "struct_score": scored["struct_score"],
        "truth": {e["field"]: e["value"] for e in truth.first()["truth"]},
        "mapping": mapping,
        "standardized": apply_mapping(rows, mapping),
        "error": None,
    }


def evaluate_dataset(
    spark: SparkSession, root: str, name: str, config: str | None, card_id: str,
    gt_root: str, method: Method, n_samples: int | None = vocab.EVAL_ROWS, **options,
) -> dict:
    """Open a dataset and the reference records of its card, then evaluate.

    Both take the first split that opens; the records lie under
    ``<gt_root>/<card_id>``.
    """
    raw = load_split(spark, root, name, config)
    gt = load_split(spark, gt_root, card_id)
    return evaluate(raw, gt, card_id, method, n_samples=n_samples, **options)


def evaluate_spec_dataset(
    spark: SparkSession, root: str, name: str, config: str | None, spec: Mapping,
    method: Method, n_samples: int | None = vocab.SPEC_EVAL_ROWS,
) -> dict:
    """Open a dataset and evaluate it against a declared spec."""
    raw = load_split(spark, root, name, config)
    return evaluate_spec(raw, spec, name, config, method, n_samples)


def propose_all(
    columns: DataFrame, sampled: DataFrame, methods: Mapping[str, Method]
) -> tuple[DataFrame, dict[str, str]]:
    """Proposals of all methods over the columns and first rows of datasets.

    Each method runs on its own and its proposals, a row per dataset, are
    written. So one that raises, here or in the workers, is left out with its
    message kept, and scoring runs none of them again. One that raises for some
    datasets only has an ``error`` in their proposals.
    """
    none = F.lit(None).cast("string")
    parts, errors = [keyword_match(columns).limit(0).withColumn("error", none)], {}
    for name, method in methods.items():
        try:
            part = method(columns, sampled).withColumn("method", F.lit(name))
            if "error" not in part.columns:
                part = part.withColumn("error", none)
            parts.append(written(part.select(parts[0].columns), f"proposals-{name}"))
        except Py4JError:  # the engine itself, not the method
            raise
        except Exception as exc:
            errors[name] = f"{type(exc).__name__}: {str(exc).strip()}"
    return union_all(parts), errors


def records_truth(
    rows: DataFrame, gt: DataFrame, n: int | None = vocab.OVERLAP_ROWS,
) -> DataFrame:
    """``(dataset, gt_cols, error)`` of schemaless datasets from their reference records.

    Records that name no column give an empty set; a dataset with a record that cannot
    be read has no set but an ``error``. ``n`` rows of each side take part in value
    matching, all rows in the names.
    """
    rows, gt = with_json(rows, "row"), with_json(gt, "task_data")
    places = written(column_places(rows), "places")
    near = rows
    if n is not None:
        near = written(first_rows(rows, "dataset", ["row_id"], n).drop("rn"), "first-rows")
        gt = first_rows(gt, "dataset", ["row_id"], n)
    cells = truth_cells(gt)
    found = truth_columns(
        with_name_fallback(overlap_of(cells, near, places), seen_columns(places)))
    broken = unreadable_datasets(cells).withColumn("error", F.lit(vocab.UNREADABLE))
    return (
        cells.select("dataset").distinct().join(found, "dataset", "left")
        .join(broken, "dataset", "left")
        .select("dataset", F.when(F.col("error").isNull(), F.coalesce(
            "gt_cols", text_array([]))).alias("gt_cols"), "error")
    )


def grid(
    datasets: DataFrame, methods: Sequence[str], proposals: DataFrame, truth: DataFrame,
    errors: Mapping[str, str] | None = None,
) -> DataFrame:
    """Every (dataset, method) pair with its score, null and with its error where it failed.

    ``truth`` is ``(dataset, gt_cols)`` and may have an ``error`` for a dataset.
    """
    known = truth.where("error is null") if "error" in truth.columns else truth
    scored = struct_scores(proposals.where("error is null"), known).drop("task", "status", "error")
    raised = proposals.where("error is not null").select(
        "dataset", "method", F.col("error").alias("raised"))
    listed = datasets.select("dataset").distinct()
    if "error" not in truth.columns:
        listed = listed.withColumn("truth_error", F.lit(None).cast("string"))
    else:
        listed = listed.join(
            truth.select("dataset", F.col("error").alias("truth_error")), "dataset", "left")
    pairs = listed.select(
        "dataset", "truth_error", F.explode(text_array(methods)).alias("method")
    )
    message = F.lit(None).cast("string")
    for name, text in (errors or {}).items():
        message = F.when(F.col("method") == name, F.lit(text)).otherwise(message)
    pair = ["dataset", "method"]
    return pairs.join(scored, pair, "left").join(raised, pair, "left").withColumn(
        "error",
        F.when(F.col("score").isNull(), F.coalesce(
            "raised", message, "truth_error", F.lit("no mapping or ground truth"))),
    ).drop("truth_error", "raised")


def run_evaluation(
    rows: DataFrame, gt: DataFrame, methods: Mapping[str, Method],
    n: int | None = vocab.OVERLAP_ROWS, datasets: DataFrame | None = None,
) -> DataFrame:
    """All schemaless datasets × methods against reference records:
    ``(dataset, method, score, struct_score, gt_cols, pred_cols, entries, code, error)``.

    The results are written to the shared folder, so that reports read them
    instead of evaluating again.
    """
    top = head(rows)
    proposals, errors = propose_all(columns_of_rows(top), samples(top), methods)
    truth = written(records_truth(rows, gt, n), "truth")
    listed = top if datasets is None else datasets
    return written(grid(listed, list(methods), proposals, truth, errors), "results")


def content_digests(rows: DataFrame, gt: DataFrame, text: str = "") -> DataFrame:
    """``(dataset, digest)`` of the rows and reference records of each dataset with rows.

    Sums of hashes, so neither order nor partitions matter; ``text`` goes into all.
    """
    parts = [
        with_json(df, c).select("dataset", F.lit(c).alias("side"), *[
            F.xxhash64(F.lit(seed), "row_id", c).cast("decimal(38,0)").alias(f"h{seed}")
            for seed in (1, 2)])
        for df, c in ((rows, "row"), (gt, "task_data"))
    ]
    sums = union_all(parts).groupBy("dataset", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    return sums.groupBy("dataset").agg(F.bool_or(F.col("side") == "row").alias("has_rows"), F.sha2(F.to_json(F.struct(
        F.lit(text).alias("text"),
        F.array_sort(F.collect_list(F.struct("side", "n", "h1", "h2"))).alias("sums"))), 256)
        .alias("digest")).where("has_rows").drop("has_rows")


def run_evaluation_changed(
    rows: DataFrame, gt: DataFrame, methods: Mapping[str, Method], path: str, run: str,
    n: int | None = vocab.OVERLAP_ROWS, settings: str = "",
) -> DataFrame:
    """``run_evaluation`` of the datasets that changed since the last run at ``path``.

    Results are kept by dataset with a digest of its rows, its records, the names of the
    methods, ``n`` and ``settings`` (a text that the caller changes with the methods
    themselves). A dataset whose digest is kept is not evaluated again; others replace
    their results. All results come back, with the ``run`` that made them.
    """
    spark = rows.sparkSession
    stated = json.dumps([list(methods), n, settings])
    now = written(content_digests(rows, gt, stated), "digests")
    try:
        kept = spark.read.parquet(path).select("dataset", "digest").distinct()
        todo = written(now.join(kept, ["dataset", "digest"], "left_anti"), "changed")
    except AnalysisException:
        todo = now
    if not todo.isEmpty():
        own = [df.join(todo.select("dataset"), "dataset", "left_semi") for df in (rows, gt)]
        found = run_evaluation(*own, methods, n).join(todo, "dataset").withColumn(
            "run", F.lit(run))
        found.hint("rebalance", "dataset").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)
    return spark.read.parquet(path).join(now, ["dataset", "digest"], "left_semi").drop("digest")


def run_evaluation_tables(
    frames: Mapping[str, DataFrame], truths: Mapping[str, DataFrame],
    methods: Mapping[str, Method], n: int | None = vocab.OVERLAP_ROWS,
    orders: Mapping[str, list[str]] | None = None, column: str = "task_data",
) -> DataFrame:
    """``run_evaluation`` over typed tables, each with a table of reference records.

    Columns stay columns: names come from the schemas, and value matching reads the
    tables as they are. ``orders`` names the columns that order each pair of tables.
    """
    spark = next(iter(frames.values())).sparkSession
    orders = orders or {}
    columns = catalog(spark, frames)
    sampled = union_all(
        sample_rows(df, orders.get(name, df.columns[:1]), vocab.PROMPT_ROWS)
        .withColumn("dataset", F.lit(name)) for name, df in frames.items())
    proposals, errors = propose_all(columns, sampled, methods)
    matched, broken = [], []
    for name, gt in truths.items():
        order = orders.get(name)
        matched.append(overlap_frames(frames[name], gt, name, n, order, order, column))
        records = with_json(gt, column)
        if n is not None:
            records = records.orderBy(*exact_order(order or gt.columns[:1])).limit(n)
        broken.append(records.agg(F.bool_or(unreadable(F.col(column))).alias("bad")).select(
            F.lit(name).alias("dataset"), F.coalesce("bad", F.lit(False)).alias("bad")))
    found = truth_columns(with_name_fallback(union_all(matched), column_sets(columns)))
    truth = written(
        union_all(broken).join(found, "dataset", "left").select(
            "dataset",
            F.when(~F.col("bad"), F.coalesce("gt_cols", text_array([]))).alias("gt_cols"),
            F.when(F.col("bad"), F.lit(vocab.UNREADABLE)).alias("error")), "truth")
    return written(grid(columns, list(methods), proposals, truth, errors), "results")


def run_evaluation_specs(
    rows: DataFrame, specs: DataFrame, methods: Mapping[str, Method]
) -> DataFrame:
    """The same against declared specs ``(name, config, spec)``, spec as JSON; a
    dataset's id is ``name/config``."""
    top = head(rows)
    named = specs.select(dataset_id(F.col("name"), F.col("config")).alias("dataset"), "spec")
    truth = spec_truth(spec_entries(named), column_sets(columns_of_rows(top)))
    proposals, errors = propose_all(columns_of_rows(top), samples(top), methods)
    return written(grid(named, list(methods), proposals, truth, errors), "results")


def report(results: DataFrame) -> DataFrame:
    """Result rows for files: lists as text, mapping as JSON, failures as 0.0."""
    listed = lambda c: F.array_join(F.coalesce(c, text_array([])), ",")
    return results.select(
        "dataset",
        "method",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        listed("gt_cols").alias("gt_cols"),
        listed("pred_cols").alias("pred_cols"),
        F.coalesce(mapping_json(F.col("entries")), F.lit("{}")).alias("mapping"),
        F.coalesce("code", F.lit("")).alias("code"),
        "error",
    )
