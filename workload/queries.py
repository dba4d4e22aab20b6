"""Registered queries: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import (
    catalog_task,
    entries_from_json,
    entries_of,
    half_even,
    mapping_json,
    task_match,
    union_all,
)
from colmap.operators.apply import apply_mapping, rename_text, resolve_entries
from colmap.operators.inference import infer, infer_in_waves
from colmap.operators.matching import embedding_match, keyword_match
from colmap.operators.prompts import build_prompts, samples
from colmap.operators.responses import extract, fill_missing, parse_responses
from colmap.operators.schema import (
    catalog,
    cells,
    column_sets,
    column_types,
    columns_of_rows,
    head,
    value_counts,
)
from colmap.operators.scores import (
    all_columns_valid,
    field_recall,
    presence_scores,
    struct_scores,
)
from colmap.operators.specs import inspection, spec_entries, spec_truth
from colmap.operators.truth import (
    column_places,
    seen_columns,
    expand_task_data,
    first_fields,
    overlap_frames,
    overlap_records,
    with_name_fallback,
)
from colmap.plans.evaluation import (
    evaluate_dataset,
    records_truth,
    report,
    run_evaluation,
    run_evaluation_changed,
    run_evaluation_specs,
    run_evaluation_tables,
)
from colmap.plans.methods import (
    embedding_method,
    function_method,
    keyword_method,
    model_method,
)
from colmap.plans.report import method_average, score_pivot, score_table
from colmap.plans.standardize import (
    load_standardized_dataset_local,
    row_plans,
    save_catalog,
    standardize_catalog,
    standardize_rows,
)
from colmap.session import scratch_path, written
from colmap.sources.cards import discover, read_cards, write_cards
from colmap.sources.registry import discover_tasks, seeded_sample
from colmap.sources.sinks import read_catalog, read_csv, write_csv
from colmap.sources.splits import load_rows, load_split, raw_columns
from colmap.streaming.standardize import (
    discover_stream,
    extract_stream,
    read_stream,
    standardize_catalog_stream,
    standardize_stream,
    write_stream,
)
from workload import inputs
from workload.inputs import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOC_MAPPING = {
    "task": "classification", "text": "body", "label": "target",
    "text_type": "body", "language": "english",
}
DECODED = {**DOC_MAPPING, "classes": ["bad", "good"]}
DIGITS = ["zero", "one", "two", "three", "four", "five", "six"]


def frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {name: load_split(spark, sf, name) for name in inputs.TABLES}



# ---- sources and schemas

def catalog_columns(spark, sf):
    return union_all([value_counts(df, name) for name, df in frames(spark, sf).items()])


def catalog_cells(spark, sf):
    return cells(frames(spark, sf), keyed=True).groupBy("dataset", "pos", "col").agg(
        F.count(F.lit(1)).alias("n_values"))


def row_columns(spark, sf):
    return columns_of_rows(inputs.records(spark, sf))


def split_fallback(spark, sf):
    docs = load_split(spark, sf, "documents")
    return docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


def card_discovery(spark, sf):
    return discover(inputs.cards(spark, sf))


def card_discovery_ordered(spark, sf):
    """Families in another order, and only some of them."""
    return discover(inputs.cards(spark, sf), ["generation", "nli", "unknown"])


def task_registry(spark, sf):
    return discover_tasks(inputs.part_tasks(spark, sf), ["Classification", "TokenClassification"])


def seeded(spark, sf):
    return seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id")


def csv_sink(spark, sf):
    df = apply_mapping(inputs.doc_quality(spark, sf), DECODED)
    path = scratch_path(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


# ---- matching

def keyword(spark, sf):
    return keyword_match(columns_of_rows(inputs.records(spark, sf)))


def keyword_entries(spark, sf):
    return keyword(spark, sf).select("dataset", F.inline("entries")).select(
        "dataset", "pos", "field", "value"
    )


def keyword_task(spark, sf):
    return keyword(spark, sf).select("dataset", "task", "status")


def table_fields(spark, sf):
    """Synonym lookup over the given tables, applied to all of their rows."""
    tables = frames(spark, sf)
    found = keyword_match(catalog(spark, tables))
    mappings = {
        r["dataset"]: {e["field"]: e["value"] for e in r["entries"]} for r in found.collect()
    }
    parts = []
    for name, df in tables.items():
        std = apply_mapping(df, mappings[name])
        if std.columns:
            parts.append(value_counts(std, name).withColumn("task", F.lit(mappings[name]["task"])))
    return union_all(parts).drop("dtype")


def embedding(spark, sf):
    """Vectors of each label as a dataset; the mean vectors of all labels as fields."""
    vectors = table(spark, sf, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
             .alias("v"))
        .orderBy("label")
    )
    # one vector per label, as any caller of the operator has them
    fields = {f"like{r['label']}": r["v"] for r in means.collect()}
    columns = vectors.select(
        F.concat(F.lit("label"), "label").alias("dataset"),
        F.col("vec_id").alias("pos"),
        F.concat(F.lit("vec"), "vec_id").alias("col"),
        "embedding",
    )
    return embedding_match(columns, fields, 0.35).select(
        "dataset", F.inline("entries")
    ).select("dataset", "field", "value")


def prompt_texts(spark, sf):
    top = head(inputs.records(spark, sf))
    columns, sampled = columns_of_rows(top), samples(top)
    api = build_prompts(columns, sampled, "api", "openai/some-model", "All rows are invented.")
    local = build_prompts(columns, sampled, "local", "other/model")
    return api.unionByName(local).select(
        "dataset", "method", F.md5("user").alias("user_md5"),
        F.length("system").alias("system_length"), "response_format",
    )


def keyword_model(model_id: str):
    """A stand-in for a language model: it answers by synonym lookup, as prose,
    fence or after thinking. Deterministic."""
    import json as js

    synonyms = vocab.FIELD_SYNONYMS

    def answer(prompt: dict) -> str:
        start = prompt["user"].index("- Columns: ") + len("- Columns: ")
        names = js.JSONDecoder().raw_decode(prompt["user"], start)[0]
        found = {}
        for field, words in synonyms.items():
            hits = [n for n in names if n.lower() in words]
            if hits:
                found[field] = hits[0]
        found["task"] = "nli" if {"text_a", "text_b"} & set(found) else "classification"
        body = js.dumps(found)
        forms = [
            body,
            f"Here it is.\n```json\n{body}\n```",
            f"<think>Which column is text?</think>\n{body}",
        ]
        return forms[len(names) % len(forms)]

    return answer


def broken_model(model_id: str):
    raise RuntimeError("no such model")


def infer_stub(spark, sf):
    rows = inputs.records(spark, sf)
    return standardize_catalog(rows, model_method(keyword_model, "local", "stub")).select(
        "dataset", "method", mapping_json(F.col("entries")).alias("mapping"),
        "task", "status", "code", "score", "catalog_task",
    )


def patchy_model(model_id: str):
    """Answers like ``keyword_model``, but not for datasets with an ``idx`` column."""
    answer = keyword_model(model_id)

    def some(prompt: dict) -> str:
        if '"idx"' in prompt["user"]:
            raise RuntimeError("busy")
        return answer(prompt)

    return some


def infer_resume(spark, sf):
    """A first run fails for some; a second one at the same path fills only those."""
    top = head(inputs.records(spark, sf))
    prompts = build_prompts(columns_of_rows(top), samples(top), "local", "stub")
    path = scratch_path(spark, "responses")
    first = written(infer(prompts, patchy_model, path), "first").select(
        "dataset", F.col("error").alias("first_error"))
    second = infer(prompts, keyword_model, path)
    return parse_responses(second, "local").join(first, "dataset").select(
        "dataset", "first_error", "status", "task")


def standardize_all(spark, sf):
    """Every document's row in the standard form of its dataset."""
    fields = standardize_rows(inputs.records(spark, sf), classes_method)
    return fields.select("dataset", "row_id", F.explode("fields").alias("field", "value")).select(
        "dataset", "row_id", "field", F.md5("value").alias("value_md5"))


def classes_method(columns, sampled):
    """Synonyms, with class names and an annotation."""
    extra = entries_from_json(F.lit('{"classes": ["bad", "good"], "text_type": "document"}'))
    return keyword_match(columns).withColumn("entries", F.transform(
        F.concat("entries", extra), lambda e, i: e.withField("pos", i)))


def letter_vectors(names):
    """An encoder: how often each letter occurs in a name."""
    return [[float(n.lower().count(chr(c))) for c in range(97, 123)] for n in names]


def embedding_names(spark, sf):
    """Column names encoded, compared with the encoded standard fields."""
    found = embedding_method(letter_vectors)(
        columns_of_rows(inputs.records(spark, sf)), None)
    return found.select("dataset", F.inline("entries")).where("field <> 'task'").select(
        "dataset", "field", "value")


def infer_errors(spark, sf):
    """A model that always fails: error kept per prompt, mapping empty."""
    top = head(inputs.records(spark, sf))
    prompts = build_prompts(columns_of_rows(top), samples(top), "api", "broken")
    responses = infer(prompts, broken_model, scratch_path(spark, "responses"))
    failed = parse_responses(responses, "api").drop("entries")
    return failed.join(responses.select("dataset", "error"), "dataset")


# ---- responses

def _reply_fields(parsed):
    fields = F.map_from_entries(
        F.transform("entries", lambda e: F.struct(e["field"], e["value_json"]))
    )
    pick = lambda k: F.try_element_at(fields, F.lit(k)).alias(k)
    return parsed.select(
        "doc_id",
        F.col("entries").isNotNull().alias("ok"),
        F.coalesce(F.array_size("entries"), F.lit(0)).alias("n_fields"),
        *[pick(k) for k in ("task", "text", "text_a", "label", "size", "classes")],
    )


def response_extract(spark, sf):
    return _reply_fields(extract(inputs.replies(spark, sf), "strict"))


def response_lenient(spark, sf):
    return _reply_fields(extract(inputs.replies(spark, sf), "lenient"))


def response_failures(spark, sf):
    replies = inputs.replies(spark, sf)
    parsed = parse_responses(replies, "local")
    known = replies.select("dataset").unionByName(
        replies.select(F.concat("dataset", F.lit("-empty")).alias("dataset"))
    )
    return fill_missing(parsed, known, "local_llm").groupBy("method", "status", "code").agg(
        F.count(F.lit(1)).alias("n")
    )


def task_family(spark, sf):
    words = F.array(*[F.lit(w) for w in
                      ("NLI", "classification", "Generation", "summarization", "qa", "regression")])
    return table(spark, sf, "documents").select(
        "doc_id", F.get(words, (F.col("doc_id") % 7).cast("int")).alias("task")
    ).select("doc_id", "task", catalog_task(F.col("task")).alias("catalog_task"))


# ---- applying mappings

def standardize_single(spark, sf):
    return apply_mapping(inputs.doc_quality(spark, sf), DOC_MAPPING)


def standardize_pair(spark, sf):
    return apply_mapping(
        inputs.chat_pairs(spark, sf),
        {"task": "generation", "text_a": "prompt", "text_b": "response", "id": "conv_id",
         "text_a_type": "question"},
    )


def standardize_dup_ref(spark, sf):
    return apply_mapping(
        inputs.doc_quality(spark, sf), {"text": "body", "id": "doc_id", "label": "body"}
    )


def label_decode(spark, sf):
    return apply_mapping(inputs.doc_quality(spark, sf), DECODED)


def label_out_of_range(spark, sf):
    return apply_mapping(
        table(spark, sf, "embeddings"), {"id": "vec_id", "label": "label", "classes": DIGITS}
    )


def resolve(spark, sf):
    rows = inputs.records(spark, sf)
    columns = columns_of_rows(rows)
    proposals = columns.select("dataset").distinct().select(
        "dataset",
        F.lit("hand").alias("method"),
        entries_of([
            ("text", F.lit("sentence")), ("label", F.lit("label")), ("text_type", F.lit("label")),
            ("classes", F.lit("label")), ("task", F.lit("label")), ("tone", F.lit("warm")),
        ]).alias("entries"),
    )
    return resolve_entries(proposals, column_sets(columns))


def rename_plan(spark, sf):
    return rename_text(keyword(spark, sf))


# ---- ground truth

def taskdata_expand(spark, sf):
    return expand_task_data(inputs.doc_task_data(spark, sf), "doc_id")


def taskdata_props(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("props").alias("task_data"))
    return expand_task_data(events, "event_id")


def taskdata_fields(spark, sf):
    return first_fields(inputs.reference(spark, sf))


def _matches(df):
    return df.select("dataset", "field", "pos", "n_gt", "col", "hits")


def value_overlap_10(spark, sf):
    return _matches(overlap_records(inputs.records(spark, sf), inputs.reference(spark, sf), 10))


def value_overlap_full(spark, sf):
    return _matches(overlap_records(inputs.records(spark, sf), inputs.reference(spark, sf), None))


def value_overlap_table(spark, sf):
    return _matches(overlap_frames(
        inputs.doc_quality(spark, sf), inputs.doc_task_data(spark, sf), "doc_quality", None))


def value_overlap_lineitem(spark, sf):
    return _matches(overlap_frames(
        table(spark, sf, "lineitem"), inputs.lineitem_reference(spark, sf), "lineitem", None))


def overlap_malformed(spark, sf):
    """Records of which some are broken, followed by text, or quoted otherwise."""
    rows, gt = inputs.records(spark, sf), inputs.malformed_reference(spark, sf)
    return _matches(overlap_records(rows, gt, None))


def unreadable_truth(spark, sf):
    rows, gt = inputs.records(spark, sf), inputs.malformed_reference(spark, sf)
    return records_truth(rows, gt, None).select(
        "dataset", F.array_join("gt_cols", ",").alias("gt_cols"), "error")


def label_fallback(spark, sf):
    rows, gt = inputs.late_records(spark, sf), inputs.reference(spark, sf)
    names = seen_columns(column_places(rows))
    return with_name_fallback(overlap_records(rows, gt, None), names).select(
        "dataset", "field", "col", "how"
    )


def _spec_truth(spark, sf):
    specs = inputs.specs(spark, sf)
    named = spec_entries(specs.withColumn("dataset", F.col("id")), "mapping")
    return spec_truth(named, column_sets(columns_of_rows(inputs.records(spark, sf))))


def spec_ground_truth(spark, sf):
    return _spec_truth(spark, sf).select("dataset", F.posexplode("truth").alias("pos", "e")).select(
        "dataset", "pos", F.col("e.field").alias("field"), F.col("e.value").alias("value")
    )


def spec_unknown_columns(spark, sf):
    specs = spec_entries(inputs.specs(spark, sf).withColumn("dataset", F.col("id")), "mapping")
    return spec_truth(specs).select(
        "dataset", F.array_join("gt_cols", ",").alias("gt_cols"), "structure"
    )


def spec_structure(spark, sf):
    return inspection(_spec_truth(spark, sf))


# ---- scores

def presence_score(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), F.col("event_id").alias("row_id"),
        # some rows lack the mapped column
        F.when(F.col("event_id") % 5 == 4, F.lit('{"z": 1}')).otherwise(F.col("props")).alias("row"),
    )
    kinds = events.select("dataset").distinct()
    make = lambda name, *pairs: kinds.select(
        "dataset", F.lit(name).alias("method"),
        entries_of([(f, F.lit(v)) for f, v in pairs]).alias("entries"))
    proposals = union_all([
        make("column", ("task", "qa"), ("text", "k"), ("label", "absent")),
        make("task_only", ("task", "qa")),
        make("empty"),
    ])
    parts = [
        presence_scores(proposals, events, n).select(
            "dataset", "method", F.lit(n).alias("n"), "score")
        for n in (10, 1000000)
    ]
    return union_all(parts)


def presence_records(spark, sf):
    """The optional column ``flag`` is required where the first row has it."""
    rows = inputs.records(spark, sf)
    proposals = rows.select("dataset").distinct().select(
        "dataset", F.lit("hand").alias("method"),
        entries_of([("task", F.lit("qa")), ("label", F.lit("flag"))]).alias("entries"),
    )
    return presence_scores(proposals, rows, 20).select("dataset", "score")


def _scored(spark, sf):
    rows, gt = inputs.records(spark, sf), inputs.reference(spark, sf)
    top = head(rows)
    found = keyword_match(columns_of_rows(top))
    return struct_scores(found, records_truth(rows, gt, None).where("error is null"))


def jaccard_scores(spark, sf):
    return _scored(spark, sf).select(
        "dataset", "method", "score", F.array_join("gt_cols", ",").alias("gt_cols"),
        F.array_join("pred_cols", ",").alias("pred_cols"),
    )


def spec_scores(spark, sf):
    specs = discover_tasks(
        inputs.specs(spark, sf),
        ["Classification", "MultipleChoice", "TokenClassification", "SequenceToSequence"])
    return run_evaluation_specs(
        inputs.records(spark, sf), specs, {"keyword": keyword_method()}
    ).select("dataset", "method", "score", F.array_join("gt_cols", ",").alias("gt_cols"))


TASK_WORDS = ["tasks.classification.multi_class", "Sentiment", "nli", "entailment", "qa.open",
              "summarization.abstractive", "translation", "regression"]


def task_matches(spark, sf):
    words = F.array(*[F.lit(w) for w in TASK_WORDS])
    named = table(spark, sf, "documents").select(
        "doc_id",
        F.get(words, (F.col("doc_id") % 8).cast("int")).alias("gt_task"),
        F.get(words, (F.col("n_chars") % 8).cast("int")).alias("pred_task"),
    )
    return named.withColumn("same", task_match(F.col("gt_task"), F.col("pred_task")))


def columns_valid(spark, sf):
    """Synonym mappings, and one fixed mapping that fits some datasets only."""
    columns = column_sets(columns_of_rows(inputs.records(spark, sf)))
    found = keyword(spark, sf).select("dataset", "entries").unionByName(
        columns.select("dataset", entries_of([
            ("task", F.lit("qa")), ("text", F.lit("text")), ("label", F.lit("label")),
        ]).alias("entries")))
    return found.join(columns, "dataset").select(
        "dataset", mapping_json(F.col("entries")).alias("mapping"),
        all_columns_valid(F.col("entries"), F.col("cols")).alias("valid"),
    )


def mapping_recall(spark, sf):
    truth = first_fields(inputs.reference(spark, sf)).groupBy("dataset").agg(
        F.collect_list("field").alias("fields"))
    found = keyword(spark, sf)
    return found.join(truth, "dataset").select(
        "dataset", half_even(field_recall(F.col("fields"), F.col("entries")), 6).alias("recall"),
        field_recall(F.slice("fields", 1, 0), F.col("entries")).alias("without_truth"),
    )


# ---- evaluation

def failing_method(columns, sampled):
    raise ValueError("no service")


def ends(names, rows):
    """The first column is the text and the last one the label; not for indexed rows."""
    if "idx" in names:
        raise ValueError("indexed")
    return {"text": names[0], "label": names[-1]}


def _grid(spark, sf):
    methods = {
        "keyword": keyword_method(),
        "embedding": embedding_method(letter_vectors),
        "local_llm": model_method(keyword_model, "local", "stub"),
        "api_llm": failing_method,
        "ends": function_method(ends, "ends"),
    }
    return run_evaluation(inputs.records(spark, sf), inputs.reference(spark, sf), methods, None)


def eval_tables(spark, sf):
    """Typed tables against their records, without a detour through JSON rows."""
    frames = {"doc_quality": inputs.doc_quality(spark, sf), "lineitem": table(spark, sf, "lineitem")}
    truths = {"doc_quality": inputs.doc_task_data(spark, sf),
              "lineitem": inputs.lineitem_reference(spark, sf)}
    methods = {"keyword": keyword_method(), "letters": embedding_method(letter_vectors),
               "api_llm": failing_method}
    return run_evaluation_tables(frames, truths, methods, None).select(
        "dataset", "method", "score", F.array_join("gt_cols", ",").alias("gt_cols"), "error")


GRID_METHODS = ["keyword", "embedding", "local_llm", "api_llm", "ends"]


def eval_grid(spark, sf):
    return _grid(spark, sf).select("dataset", "method", "score", "struct_score", "error")


def eval_report(spark, sf):
    return report(_grid(spark, sf))


def score_pivots(spark, sf):
    return score_pivot(_grid(spark, sf), methods=GRID_METHODS)


def score_tables(spark, sf):
    return score_table(_grid(spark, sf), methods=GRID_METHODS)


def method_averages(spark, sf):
    return method_average(_grid(spark, sf))


# ---- splits, configs, cards and whole datasets in files that Spark wrote

def _split_folder(spark, sf):
    """Documents as the test split of ``docs``, and a train split that no reader opens."""
    root = scratch_path(spark, "splits")
    table(spark, sf, "documents").write.parquet(f"{root}/docs/test")
    table(spark, sf, "labels").select(F.to_json(F.struct("*")).alias("v")).write.text(
        f"{root}/docs/train")
    return root


def split_corrupt(spark, sf):
    """The train split is not Parquet; with a schema given it is passed over as well."""
    schema = table(spark, sf, "documents").schema
    docs = load_split(spark, _split_folder(spark, sf), "docs", schema=schema)
    return docs.select("doc_id", "lang", "n_chars")


def config_pick(spark, sf):
    """No config is named: the first one by name serves, here that of the language de."""
    root = scratch_path(spark, "configs")
    for lang in ("fr", "de"):
        table(spark, sf, "documents").where(F.col("lang") == lang).write.parquet(
            f"{root}/docs/{lang}/train")
    return load_split(spark, root, "docs").select("doc_id", "source")


def limited_rows(spark, sf):
    """The first rows by the order asked for."""
    root = _split_folder(spark, sf)
    return load_rows(spark, root, "docs", limit=150, order=["n_chars", "doc_id"]).select(
        "doc_id", "n_chars")


def dataset_columns(spark, sf):
    """Column names of a dataset from its schema, and none of one that is not there."""
    root = _split_folder(spark, sf)
    lines = [(name, col) for name in ("docs", "absent")
             for col in sorted(raw_columns(spark, root, name))]
    return spark.createDataFrame(lines, "name string, col string")


def card_files(spark, sf):
    """A card file per supplier in one catalog and a copy of some in another."""
    roots = [scratch_path(spark, "catalog") for _ in range(2)]
    suppliers = table(spark, sf, "supplier")
    tasks = F.array(*[F.lit(t) for t in (
        "tasks.qa.open", "tasks.classification.binary", "tasks.regression")])
    for pos, root in enumerate(roots):
        write_cards(suppliers.where(F.col("s_suppkey") % 3 >= pos).select(F.to_json(F.struct(
            F.lit("task_card").alias("__type__"),
            F.struct(F.lit("load_hf").alias("__type__"), F.col("s_name").alias("path"),
                     F.lit(f"catalog{pos}").alias("name")).alias("loader"),
            F.get(tasks, (F.col("s_nationkey") % 3).cast("int")).alias("task"),
        ))), f"{root}/cards")
    return discover(read_cards(spark, [*roots, f"{roots[0]}/none"])).select(
        "name", "config", "task_type")


def card_stream(spark, sf):
    """Cards that arrive in two catalogs, one after the other; the first of an id stays."""
    source = scratch_path(spark, "card-source")
    raw = inputs.cards(spark, sf)
    path, progress = scratch_path(spark, "cards"), scratch_path(spark, "cards-progress")
    for pos in (0, 1):
        raw.where(F.col("catalog_pos") == pos).write.mode("append").parquet(source)
        arriving = read_stream(spark, source, raw.schema)
        discover_stream(arriving, path, progress).awaitTermination()
    return spark.read.parquet(path).drop("batch")


def load_standardized(spark, sf):
    """A dataset opened by name and standardized with a model's mapping."""
    root = scratch_path(spark, "named")
    inputs.doc_quality(spark, sf).select("doc_id", F.col("body").alias("text"), F.col(
        "target").alias("label")).write.parquet(f"{root}/quality/validation")
    found = load_standardized_dataset_local(
        spark, root, "quality", model_id="stub", factory=keyword_model, order=["doc_id"])
    return found["standardized"].withColumn("score", F.lit(found["score"]))


def evaluate_named(spark, sf):
    """A dataset and the records of its card, both opened by name."""
    root, cards = scratch_path(spark, "raw"), scratch_path(spark, "truth")
    inputs.doc_quality(spark, sf).write.parquet(f"{root}/quality/train")
    inputs.doc_task_data(spark, sf).write.parquet(f"{cards}/card/test")
    found = evaluate_dataset(
        spark, root, "quality", None, "card", cards, keyword_method(), n=None,
        order=["doc_id"], gt_order=["doc_id"])
    # as many rows as the evaluation standardized
    return found["standardized"].select(
        F.lit(found["dataset"]).alias("dataset"), F.lit(found["score"]).alias("score"),
        F.lit(",".join(found["gt_cols"])).alias("gt_cols"),
        F.lit(",".join(found["pred_cols"])).alias("pred_cols"),
        F.lit(json.dumps(found["mapping"])).alias("mapping"),
    ).groupBy("dataset", "score", "gt_cols", "pred_cols", "mapping").agg(
        F.count(F.lit(1)).alias("n_rows"))


# ---- catalogs with types, as streams, and evaluated anew only where they changed

def row_schemas(spark, sf):
    """Columns that appear late, are null, or change their type from row to row."""
    return column_types(inputs.shifting_records(spark, sf))


def catalog_sink(spark, sf):
    """Every document's row standardized, written by dataset and read back with types."""
    path = scratch_path(spark, "catalog")
    save_catalog(inputs.records(spark, sf), keyword_method(), path)
    types = spark.read.parquet(f"{path}/types")
    value = F.col("value")
    return read_catalog(spark, path).select(
        "dataset", "method", "row_id", F.explode("fields").alias("field", "value"),
    ).join(types, ["dataset", "method", "field"]).select(
        "dataset", "method", "row_id", "field", "dtype", F.schema_of_variant(value).alias("kind"),
        F.md5(F.try_variant_get(value, "$", "string")).alias("value_md5"))


def infer_waves(spark, sf):
    """Prompts answered wave by wave; a second run asks only what failed in the first."""
    top = head(inputs.records(spark, sf))
    prompts = build_prompts(columns_of_rows(top), samples(top), "local", "stub")
    path = scratch_path(spark, "waves")
    first = written(infer_in_waves(prompts, patchy_model, path, wave=25), "first").select(
        "dataset", F.col("error").alias("first_error"))
    second = infer_in_waves(prompts, keyword_model, path, wave=25)
    return parse_responses(second, "local").join(first, "dataset").select(
        "dataset", "first_error", "status", "task")


def stream_catalog(spark, sf):
    """Events as rows of one dataset per type, standardized as they arrive."""
    def rows(events):
        return events.select(
            F.col("event_type").alias("dataset"), F.col("event_id").alias("row_id"), F.to_json(
                F.struct(F.col("event_type").alias("sentence"), F.col("user_id").alias("label"),
                         "props")).alias("row"))

    events = table(spark, sf, "events")
    plans = row_plans(rows(events), classes_method)
    path = scratch_path(spark, "stream-catalog")
    arriving = rows(read_stream(spark, f"{sf}/events.parquet*", events.schema))
    standardize_catalog_stream(
        arriving, plans, path, scratch_path(spark, "stream-progress")).awaitTermination()
    return spark.read.parquet(path).select("dataset", "row_id", F.map_entries("fields").alias(
        "m")).select("dataset", "row_id", F.array_join(F.array_sort(F.transform(
            "m", lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))),
            ";").alias("fields"))


def eval_incremental(spark, sf):
    """Two evaluations at one path; the records of one dataset change in between."""
    rows, gt = inputs.records(spark, sf), inputs.reference(spark, sf)
    methods = {"keyword": keyword_method(), "ends": function_method(ends, "ends")}
    path = scratch_path(spark, "evaluations")
    run_evaluation_changed(rows, gt, methods, path, "first", None)
    least = gt.agg(F.min("dataset").alias("least"))
    changed = gt.join(F.broadcast(least), F.lit(True), "left").withColumn("task_data", F.when(
        F.col("dataset") == F.col("least"), F.lit('{"nothing": "x"}')).otherwise(
        F.col("task_data"))).drop("least")
    return run_evaluation_changed(rows, changed, methods, path, "second", None).select(
        "dataset", "method", "score", "error", "run")


# ---- streams

EVENT_MAPPING = {"task": "classification", "id": "event_id", "text": "event_type", "label": "value",
                 "label_type": "number"}


def _stream(spark, sf, name, change, label):
    schema = table(spark, sf, name).schema
    source = read_stream(spark, f"{sf}/{name}.parquet*", schema)
    path = scratch_path(spark, label)
    result = change(source)
    write_stream(result, path, scratch_path(spark, f"{label}-progress")).awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def stream_standardize(spark, sf):
    return _stream(spark, sf, "events",
                   lambda s: standardize_stream(s, EVENT_MAPPING), "events")


def stream_extract(spark, sf):
    def change(s):
        raw = F.concat(F.lit("<think>"), "event_type", F.lit("</think>"),
                       F.lit('{"task": "qa", "props": '), "props", F.lit("}"))
        parsed = extract_stream(s.withColumn("raw", raw))
        return parsed.select("event_id", F.element_at("entries", 2)["value_json"].alias("props"))

    return _stream(spark, sf, "events", change, "replies")


def flagship(spark, sf):
    """All datasets in the documents: propose by synonym, recover the truth from
    values, score."""
    return jaccard_scores(spark, sf)


QUERIES = {
    "catalog_columns": catalog_columns,
    "catalog_cells": catalog_cells,
    "row_columns": row_columns,
    "split_fallback": split_fallback,
    "card_discovery": card_discovery,
    "card_discovery_ordered": card_discovery_ordered,
    "task_registry": task_registry,
    "seeded_sample": seeded,
    "csv_sink": csv_sink,
    "keyword_match": keyword_entries,
    "keyword_task": keyword_task,
    "table_fields": table_fields,
    "embedding_match": embedding,
    "prompt_inputs": prompt_texts,
    "infer_stub": infer_stub,
    "infer_errors": infer_errors,
    "infer_resume": infer_resume,
    "standardize_rows": standardize_all,
    "embedding_names": embedding_names,
    "response_extract": response_extract,
    "response_lenient": response_lenient,
    "response_failures": response_failures,
    "task_family": task_family,
    "standardize_single": standardize_single,
    "standardize_pair": standardize_pair,
    "standardize_dup_ref": standardize_dup_ref,
    "label_decode": label_decode,
    "label_out_of_range": label_out_of_range,
    "resolve_entries": resolve,
    "rename_plan": rename_plan,
    "taskdata_expand": taskdata_expand,
    "taskdata_props": taskdata_props,
    "taskdata_fields": taskdata_fields,
    "value_overlap_10": value_overlap_10,
    "value_overlap_full": value_overlap_full,
    "value_overlap_table": value_overlap_table,
    "value_overlap_lineitem": value_overlap_lineitem,
    "label_fallback": label_fallback,
    "overlap_malformed": overlap_malformed,
    "unreadable_truth": unreadable_truth,
    "spec_ground_truth": spec_ground_truth,
    "spec_unknown_columns": spec_unknown_columns,
    "spec_structure": spec_structure,
    "presence_score": presence_score,
    "presence_records": presence_records,
    "jaccard_scores": jaccard_scores,
    "spec_scores": spec_scores,
    "task_match": task_matches,
    "columns_valid": columns_valid,
    "mapping_recall": mapping_recall,
    "eval_grid": eval_grid,
    "eval_report": eval_report,
    "eval_tables": eval_tables,
    "score_pivot": score_pivots,
    "score_table": score_tables,
    "method_average": method_averages,
    "stream_standardize": stream_standardize,
    "stream_extract": stream_extract,
    "split_corrupt": split_corrupt,
    "config_pick": config_pick,
    "limited_rows": limited_rows,
    "dataset_columns": dataset_columns,
    "card_files": card_files,
    "card_stream": card_stream,
    "load_standardized": load_standardized,
    "evaluate_named": evaluate_named,
    "row_schemas": row_schemas,
    "catalog_sink": catalog_sink,
    "infer_waves": infer_waves,
    "stream_catalog": stream_catalog,
    "eval_incremental": eval_incremental,
}
