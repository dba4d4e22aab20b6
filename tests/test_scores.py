"""Scores, grids and report tables."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colmap.functions.exprs import first_rows
from colmap.plans.report import show_scores
from colmap.functions.exprs import (
    catalog_task,
    entries_from_json,
    half_even,
    jaccard,
    predicted_columns,
    task_match,
    task_of,
)
from colmap.operators.schema import as_rows, catalog_rows
from colmap.operators.scores import (
    all_columns_valid,
    field_recall,
    presence_scores,
    struct_scores,
    table_presence,
)
from colmap.plans.evaluation import (
    evaluate,
    evaluate_spec,
    records_truth,
    report,
    run_evaluation,
    score_mapping,
)
from colmap.plans.methods import (
    embedding_method,
    function_method,
    keyword_method,
    model_method,
)
from colmap.plans.report import method_average, present_methods, score_pivot, score_table
from colmap.plans.standardize import (
    baseline_embedding_match,
    baseline_keyword_match,
    standardize,
    standardize_catalog,
    standardize_tables,
)
from tests.conftest import rows
from workload.queries import broken_model, failing_method, keyword_model


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def texts(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_half_even_is_exact(spark):
    pairs = [(p, q) for q in range(1, 65) for p in range(q + 1)]
    df = spark.createDataFrame(pairs, "p int, q int").select(
        "p", "q", half_even(F.col("p") / F.col("q")).alias("r"))
    assert all(r["r"] == round(r["p"] / r["q"], 3) for r in df.collect())


@pytest.mark.parametrize("a, b, want", [
    ([], [], 1.0), (["x"], [], 0.0), (["x", "y"], ["y", "z"], 1 / 3), (["x"], ["x"], 1.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, jaccard(texts(a), texts(b))) == pytest.approx(want)


def test_jaccard_is_symmetric_and_bounded(spark):
    rng = random.Random(3)
    pairs = [([str(rng.randint(0, 5)) for _ in range(rng.randint(0, 4))],
              [str(rng.randint(0, 5)) for _ in range(rng.randint(0, 4))]) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(
        "a", "b", jaccard(F.col("a"), F.col("b")).alias("ab"),
        jaccard(F.col("b"), F.col("a")).alias("ba"))
    for r in df.collect():
        a, b = set(r["a"]), set(r["b"])
        assert r["ab"] == r["ba"] == (len(a & b) / len(a | b) if a | b else 1.0)


@pytest.mark.parametrize("fields, task", [
    (["question", "text_a"], "nli"), (["premise"], "nli"), (["answer", "input"], "qa"),
    (["output"], "generation"), (["text", "label"], "classification"), ([], "classification")])
def test_task_of(spark, fields, task):
    assert one(spark, task_of(texts(fields))) == task


@pytest.mark.parametrize("a, b, same", [
    ("tasks.classification.multi_class", "sentiment", True), ("NLI", "Entailment", True),
    ("qa", "question_answering", True), ("summarization", "translation", True),
    ("regression", "Regression", True), ("regression", "nli", False),
    ("classification", "nli", False)])
def test_task_match(spark, a, b, same):
    assert one(spark, task_match(F.lit(a), F.lit(b))) is same


def test_catalog_task(spark):
    names = [("NLI", "tasks.classification.multi_class"), ("x", "tasks.classification.binary"),
             (None, "tasks.classification.binary"), ("translation", "tasks.translation")]
    for task, want in names:
        assert one(spark, catalog_task(F.lit(task).cast("string"))) == want


def entries(mapping):
    return entries_from_json(F.lit(json.dumps(mapping)))


def test_predicted_columns(spark):
    mapping = {"task": "t", "text": "b", "label": "made up", "x_type": "c", "classes": ["d"],
               "again": "b", "type_of_class": "e"}
    assert one(spark, predicted_columns(entries(mapping))) == ["b", "made up"]
    got = score_mapping(spark, "d", mapping, None)
    assert (got["pred_cols"], got["gt_cols"], got["score"]) == (["b", "made up"], [], 0.0)


@pytest.mark.parametrize("mapping, want", [
    ({}, True), ({"task": "t"}, True), ({"text": "a", "n": 3}, True), ({"text": "z"}, False),
    ({"a_type": "literal"}, False)])
def test_columns_valid(spark, mapping, want):
    assert one(spark, all_columns_valid(entries(mapping), texts(["a"]))) is want


@pytest.mark.parametrize("truth, mapping, want", [
    ([], {"text": "a"}, 0.0), (["text", "label"], {"text": "a", "task": "t"}, 0.5),
    (["task"], {"task": "t"}, 0.0), (["text"], {"text": 1}, 1.0)])
def test_recall(spark, truth, mapping, want):
    assert one(spark, field_recall(texts(truth), entries(mapping))) == want


@pytest.mark.parametrize("data, mapping, want", [
    ([{"a": 1}] * 4, {"task": "t", "x": "a"}, 0.4),
    ([{"a": 1}] * 12, {"task": "t"}, 1.0),
    ([{"a": 1}] * 12, {}, 0.0),
    ([{"a": 1}] * 12, {"x": "missing"}, 1.0),  # not in the first row, so not required
    ([{"a": 1}, {"b": 1}, {"a": None, "b": 2}], {"x": "a"}, 0.2),
    ([], {"task": "t"}, 0.0),
])
def test_presence(spark, data, mapping, want):
    rows_df = spark.createDataFrame(
        [("d", i, json.dumps(r)) for i, r in enumerate(data)],
        "dataset string, row_id long, row string")
    proposals = spark.range(1).select(F.lit("d").alias("dataset"), F.lit("m").alias("method"),
                                      entries(mapping).alias("entries"))
    assert presence_scores(proposals, rows_df).first()["score"] == want
    if all(set(r) == {"a"} for r in data):
        typed = spark.createDataFrame([(1,)] * len(data), "a int")
        assert table_presence(typed, mapping) == want


def test_struct_scores_need_truth(spark):
    proposals = spark.createDataFrame([("d",), ("e",)], "dataset string").select(
        "dataset", F.lit("m").alias("method"), entries({}).alias("entries"))
    truth = spark.createDataFrame([("d", [])], "dataset string, gt_cols array<string>")
    assert rows(struct_scores(proposals, truth).select("dataset", "score")) == [("d", 1.0)]


RESULTS = [("a", "keyword", 0.5), ("b", "keyword", None), ("a", "zeta", 1.0),
           ("b", "zeta", 0.0625), ("a", "local_llm", None), ("b", "local_llm", None)]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(RESULTS, "dataset string, method string, score double")


def test_tables(spark, results):
    assert present_methods(results) == ["keyword", "local_llm", "zeta"]
    got = {r["dataset"]: r.asDict() for r in score_table(results).collect()}
    assert got["Average"] == {"dataset": "Average", "keyword": 0.5, "local_llm": None, "zeta": 0.531}
    assert got["b"] == {"dataset": "b", "keyword": None, "local_llm": None, "zeta": 0.062}
    assert score_pivot(results).where("dataset = 'b'").first()["zeta"] == 0.0625
    assert rows(method_average(results)) == [("keyword", 0.5), ("local_llm", None), ("zeta", 0.531)]


def test_duplicate_results_raise(spark, results):
    with pytest.raises(PySparkException, match="duplicate result for a"):
        score_table(results.unionByName(results.limit(1))).collect()


@pytest.fixture(scope="module")
def corpus(spark):
    raw = [("d", i, json.dumps({"sentence": f"s{i}", "label": i % 2})) for i in range(30)]
    raw += [("e", i, json.dumps({"k": f"s{i}"})) for i in range(30)]
    raw += [("f", i, json.dumps({"text": "x"})) for i in range(3)]
    gt = [(d, i, json.dumps({"text": f"s{i}", "label": "good", "metadata": {}}))
          for d in ("d", "e") for i in range(30)]
    make = lambda data, name: spark.createDataFrame(
        data, f"dataset string, row_id long, {name} string")
    return make(raw, "row"), make(gt, "task_data")


def test_run_evaluation(spark, corpus):
    methods = {"keyword": keyword_method(), "api_llm": failing_method,
               "stub": model_method(keyword_model, "local", "s"),
               "broken": model_method(broken_model, "api", "b")}
    results = run_evaluation(*corpus, methods)
    got = {(r["dataset"], r["method"]): r for r in results.collect()}
    assert len(got) == 12
    score = lambda d, m: got[d, m]["score"]
    assert (score("d", "keyword"), score("d", "stub"), score("d", "broken")) == (1.0, 1.0, 0.0)
    assert (score("e", "keyword"), score("f", "keyword")) == (0.0, None)  # f has no truth
    assert got["d", "api_llm"]["error"] == "ValueError: no service"
    lines = {(r["dataset"], r["method"]): r for r in report(results).collect()}
    assert lines["d", "keyword"]["mapping"] == (
        '{"text": "sentence", "label": "label", "task": "classification"}')
    assert lines["d", "keyword"]["gt_cols"] == "label,sentence"
    assert lines["d", "api_llm"]["score"] == 0.0 and lines["d", "api_llm"]["mapping"] == "{}"
    assert lines["d", "broken"]["code"] == "# Error: LLM/API failed"


def test_plain_function_as_method(spark, corpus):
    def first_column(names, sample):
        if "k" in names:
            raise ValueError("no idea")
        return {"text": names[0], "label": "label" if "label" in sample[0] else 3}

    def with_task(names, sample):
        return {**first_column(names, sample), "task": f"rows-{len(sample)}"}

    methods = {"no_task": function_method(first_column, "no_task"),
               "mine": function_method(with_task, "mine")}
    got = {(r["dataset"], r["method"]): r for r in run_evaluation(*corpus, methods).collect()}
    # a method that raises for a dataset gives that pair no score, but its error
    assert got["d", "mine"]["score"] == 1.0 and got["e", "mine"]["score"] is None
    assert got["e", "mine"]["error"] == "ValueError: no idea"
    assert [e["value_json"] for e in got["d", "mine"]["entries"]] == [
        '"sentence"', '"label"', '"rows-5"']
    # a function's mapping counts as it is; only a model's reply needs a task
    assert got["d", "no_task"]["code"] == "Rename(field='sentence', to_field='text')"
    assert got["d", "no_task"]["score"] == 1.0


def test_partitions_do_not_matter(spark, corpus):
    raw, gt = corpus
    methods = {"keyword": keyword_method()}
    a = run_evaluation(raw.repartition(1), gt.repartition(1), methods, None)
    b = run_evaluation(raw.repartition(23), gt.repartition(17), methods, None)
    assert rows(a.drop("entries")) == rows(b.drop("entries"))


def test_standardize_catalog(spark, corpus):
    got = {r["dataset"]: r for r in standardize_catalog(corpus[0], keyword_method()).collect()}
    assert got["d"]["score"] == 1.0 and got["f"]["score"] == 0.3
    assert got["d"]["catalog_task"] == "tasks.classification.binary"


def test_one_table(spark, folder):
    raw = spark.createDataFrame([(f"s{i}", i % 2) for i in range(150)], "sentence string, label int")
    gt = raw.selectExpr("sentence as id",
                        "to_json(struct(sentence as text, 'good' as label)) as task_data")
    got = evaluate(raw, gt, "sst", keyword_method(), save_dir=f"{folder}/saved")
    assert got["score"] == got["struct_score"] == 1.0
    assert got["gt_cols"] == got["pred_cols"] == ["label", "sentence"]
    assert got["standardized"].count() == 100 and got["error"] is None
    assert got["code"] == "Rename(field='sentence', to_field='text')"
    saved = spark.read.option("header", True).csv(f"{folder}/saved/ground_truth")
    assert saved.count() == 100 and saved.columns == ["text", "label"]
    assert evaluate(raw, gt, "sst", keyword_method(), n_samples=None)["standardized"].count() == 150
    nothing = evaluate(raw.limit(0), gt, "sst", keyword_method())
    assert nothing["gt_cols"] == [] and nothing["score"] == 0.0


def test_one_table_against_spec(spark):
    raw = spark.createDataFrame([("a", "b", 1)], "premise string, hypothesis string, labels int")
    got = evaluate_spec(raw, {"sentence1": "premise", "sentence2": "hypothesis", "labels": "labels"},
                        "glue", "x", keyword_method())
    assert got["dataset"] == "glue/x" and got["score"] == round(2 / 3, 3)
    assert got["truth"] == {"sentence1": "premise", "sentence2": "hypothesis", "labels": "labels"}
    assert evaluate_spec(raw, {}, "glue", None, keyword_method())["dataset"] == "glue"


def test_standardize_one(spark):
    df = spark.createDataFrame([("t", 1)] * 4, "Review string, Score int")
    got = baseline_keyword_match(spark, df)
    assert got["mapping"] == {"text": "Review", "label": "Score", "task": "classification"}
    assert got["score"] == 0.0 and got["standardized"].columns == ["text", "label"]
    assert standardize(df, keyword_method())["score"] == 0.4
    failed = standardize(df, model_method(broken_model, "local"))
    assert (failed["mapping"], failed["score"], failed["code"]) == (
        {}, 0.0, "# Error: local LLM failed")
    empty = standardize(spark.range(1).select(), keyword_method())
    assert (empty["mapping"], empty["code"]) == ({}, "# Error: no features")
    lengths = baseline_embedding_match(spark, df, threshold=0.99, encoder=lambda ns: [
        [1.0, 0.0] if n.lower() in ("score", "label") else [0.0, float(len(n))] for n in ns])
    assert lengths["mapping"]["label"] == "Score"


def test_many_tables(spark):
    tables = {"a": spark.createDataFrame([("t",)], "text string"), "b": spark.range(2)}
    got = standardize_tables(spark, tables, model_method(keyword_model, "api", "m"))
    assert rows(got.select("dataset", "task", F.size("entries"))) == [
        ("a", "classification", 2), ("b", "classification", 1)]




def test_edges_of_a_catalog(spark):
    raw = spark.createDataFrame(
        [("empty", 1, "{}"), ("meta", 1, '{"text": "x"}')], "dataset string, row_id long, row string")
    gt = spark.createDataFrame(
        [("empty", 1, '{"text": "x"}'), ("meta", 1, '{"metadata": 1}')],
        "dataset string, row_id long, task_data string")
    methods = {"keyword": keyword_method(), "stub": model_method(keyword_model, "api", "s"),
               "embedding": embedding_method(lambda ns: [[1.0] for _ in ns])}
    got = {(r["dataset"], r["method"]): r for r in run_evaluation(raw, gt, methods).collect()}
    assert got["empty", "keyword"]["score"] == 1.0  # nothing expected, nothing predicted
    assert got["empty", "keyword"]["code"] == "# No rename steps needed"
    assert got["empty", "embedding"]["code"] == "# No rename steps needed"
    assert got["empty", "stub"]["code"] == "# Error: no features"
    assert got["meta", "keyword"]["score"] == 0.0
    def broken_encoder(names):
        if "text" in names and len(names) < 8:
            raise ValueError("encoder is gone")
        return [[1.0] for _ in names]

    half = run_evaluation(raw, gt, {"embedding": embedding_method(broken_encoder),
                                    "keyword": keyword_method()})
    got = {(r["dataset"], r["method"]): r for r in half.collect()}
    assert got["meta", "embedding"]["score"] is None and "PythonException" in got[
        "meta", "embedding"]["error"]
    assert got["meta", "keyword"]["score"] == 0.0
    lost = run_evaluation(raw, gt, {"api_llm": failing_method})
    assert rows(lost.select("dataset", "score", "error")) == [
        ("empty", None, "ValueError: no service"), ("meta", None, "ValueError: no service")]


def test_records_given_as_structs(spark):
    raw = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "id long, p string")
    text = raw.selectExpr("id", "to_json(named_struct('t', p)) as task_data")
    struct = raw.selectExpr("id", "named_struct('t', p) as task_data")
    for gt in (text, struct):
        assert evaluate(raw, gt, "d", keyword_method())["gt_cols"] == ["p"]
    packed = catalog_rows({"d": raw}, {})
    assert rows(packed) == rows(as_rows(raw, "d", "id"))
    assert records_truth(packed, struct.selectExpr("'d' as dataset", "id as row_id", "task_data")
                         ).first()["gt_cols"] == ["p"]


def test_report_shows_all_datasets(spark, capsys):
    results = spark.range(150).select(
        F.concat(F.lit("d"), "id").alias("dataset"), F.lit("keyword").alias("method"),
        F.lit(0.5).alias("score"))
    show_scores(results)
    printed = capsys.readouterr().out
    assert "Average" in printed and "d149" in printed


def test_first_rows_of_large_groups(spark):
    """More rows than Spark prunes groups for: placed by ranges, no task has a group."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("b")).otherwise(F.lit("a")).alias("g"),
        (30_000 - F.col("id")).alias("o"))
    got = first_rows(df.repartition(7), "g", ["o"], 5_000)
    stats = {r["g"]: (r["n"], r["top"], r["last"]) for r in got.groupBy("g").agg(
        F.count("*").alias("n"), F.max("rn").alias("top"), F.max("o").alias("last")).collect()}
    want = {g: sorted(30_000 - i for i in range(30_000) if (i % 3 == 0) == (g == "b"))[4_999]
            for g in "ab"}
    assert stats == {g: (5_000, 5_000, want[g]) for g in "ab"}
    near = got.where("g = 'a'").orderBy("o").limit(3).collect()
    assert [r["rn"] for r in near] == [1, 2, 3]


def test_evaluate_table_with_a_dotted_first_column(spark):
    raw = spark.createDataFrame([(1, "x", 7), (2, "y", 8)], "`a.b` long, text string, label long")
    gt = raw.select("`a.b`", F.to_json(F.struct("text", "label")).alias("task_data"))
    got = evaluate(raw, gt, "d", keyword_method())
    assert got["score"] == 1.0 and got["gt_cols"] == ["label", "text"]
