"""Typed catalogs, waves of prompts, streams of many datasets, evaluation of what changed."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import entries_from_json
from colmap.operators.apply import apply_rows, mapping_plans
from colmap.operators.bloom import key_bits, perhaps_in
from colmap.operators.inference import infer, infer_in_waves
from colmap.operators.matching import keyword_match
from colmap.operators.schema import column_types
from colmap.operators.truth import distinct_values
from colmap.plans.evaluation import content_digests, run_evaluation, run_evaluation_changed
from colmap.plans.methods import function_method, keyword_method
from colmap.plans.report import score_table
from colmap.plans.standardize import row_plans, save_catalog
from colmap.sources.sinks import read_catalog, read_dataset
from colmap.sources.splits import load_rows, load_split
from colmap.streaming.standardize import standardize_catalog_stream
from tests.conftest import rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = [
    ("a", 1, '{"text": "x", "label": 1, "size": 1.5}'),
    ("a", 2, '{"text": null, "label": 0, "size": 2, "late": {"k": [1]}}'),
    ("a", 3, '{"text": "z", "label": 7}'),
    ("b", 1, '{"sentence": "it\'s", "label": true}'),
    ("b", 2, '{"sentence": "y"} trailing'),
    ("b", 3, None),
]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(ROWS, "dataset string, row_id long, row string")


def plans_of(spark, mapping, cols):
    found = spark.createDataFrame([("a", mapping), ("b", mapping)], "dataset string, m string")
    proposals = found.select(
        "dataset", F.lit("hand").alias("method"), entries_from_json(F.col("m")).alias("entries"))
    return mapping_plans(proposals, spark.createDataFrame(cols, "dataset string, cols array<string>"))


COLS = [("a", ["text", "label", "size", "late"]), ("b", ["sentence", "label"])]


@pytest.mark.parametrize("classes, text, label", [
    ('["no", "it\'s"]', "['no', \"it's\"]", "it's"),
    ("[0.5, null]", "[0.5, None]", "None"),
    ("[]", None, "1"),
    ('"ny"', "ny", "y"),
    ('""', None, "1"),
])
def test_classes_are_shown_as_python_does(spark, listed, classes, text, label):
    plans = plans_of(spark, f'{{"label": "label", "classes": {classes}}}', COLS)
    got = {(r["dataset"], r["row_id"]): r for r in apply_rows(listed, plans).collect()}
    want = {"label": label} | ({} if text is None else {"classes": text})
    assert got["a", 1]["fields"] == want
    assert got["a", 3]["fields"]["label"] == "7"


def test_rows_that_cannot_be_read_have_an_error(spark, listed):
    plans = plans_of(spark, '{"label": "label", "tone": "warm"}', COLS)
    for typed in (False, True):
        got = apply_rows(listed, plans, typed).select(
            "dataset", "row_id", F.col("fields").isNull().alias("none"), "error").collect()
        assert sorted(map(tuple, got)) == [
            ("a", 1, False, None), ("a", 2, False, None), ("a", 3, False, None),
            ("b", 1, False, None), ("b", 2, True, vocab.UNREADABLE_ROW),
            ("b", 3, True, vocab.UNREADABLE_ROW)]


def test_types_of_all_rows(listed):
    got = [tuple(r) for r in column_types(listed).orderBy("dataset", "pos").collect()]
    assert [r[:3] for r in got] == [
        ("a", 0, "text"), ("a", 1, "label"), ("a", 2, "size"), ("a", 3, "late"),
        ("b", 0, "sentence"), ("b", 1, "label")]
    kinds = [r[3] for r in got]
    assert kinds[:2] == ["STRING", "BIGINT"] and kinds[2].startswith("DECIMAL")
    assert kinds[3:] == ["OBJECT<k: ARRAY<BIGINT>>", "STRING", "BOOLEAN"]


def test_a_written_catalog_keeps_types(spark, listed, folder):
    save_catalog(listed, keyword_method(), f"{folder}/catalog")
    one = read_dataset(spark, f"{folder}/catalog", "a", "keyword")
    assert [f.dataType.simpleString() for f in one.schema.fields] == ["bigint", "string", "bigint"]
    assert rows(one.select("row_id", "text", "label")) == [(1, "x", 1), (2, None, 0), (3, "z", 7)]
    other = read_dataset(spark, f"{folder}/catalog", "b", "keyword").orderBy("row_id").collect()
    assert [tuple(r) for r in other] == [(1, "it's", True), (2, None, None), (3, None, None)]
    assert read_catalog(spark, f"{folder}/catalog").where("error is not null").count() == 2


def test_bloom_filter_keeps_every_key(spark):
    known = spark.range(0, 30_000, 3).select(F.col("id").cast("string").alias("k"))
    left = perhaps_in(spark.range(30_000).select(F.col("id").cast("string").alias("k")),
                      key_bits(known, "k"), "k")
    assert left.columns == ["k"]
    assert known.join(left, "k", "left_anti").count() == 0
    assert 10_000 <= left.count() < 10_300


def test_distinct_values_by_type(spark):
    df = spark.createDataFrame(
        [(1, "x", 1.0, None), (1, "y" * 70, 1.0, [1]), (None, None, 2.5, [1])],
        "a int, `b.c` string, d double, e array<int>").toDF("a", "b.c", "d", "e")
    wide = df.select("*", *[F.lit(i).alias(f"w{i}") for i in range(40)])
    got = distinct_values(wide).collect()
    assert sorted(r["key"] for r in got if r["pos"] == 1)[1] == "x"
    assert {(r["pos"], r["key"]) for r in got if r["pos"] != 1} == {
        (0, "1"), (2, "1.0"), (2, "2.5"), (3, "[1]")} | {(i + 4, str(i)) for i in range(40)}


# ---- waves

def prompts_of(spark, n, note):
    return spark.range(n).select(
        F.concat(F.lit("d"), "id").alias("dataset"), F.lit("m").alias("method"),
        F.lit("local").alias("backend"), F.lit(note).alias("model_id"),
        F.col("id").cast("string").alias("user"))


def counting_model(folder):
    """Notes every prompt in a folder; ends the worker, or raises, where a file says so."""
    def answer(prompt):
        with open(f"{folder}/{prompt['user']}", "a") as out:
            out.write("x")
        if os.path.exists(f"{folder}.fatal{prompt['user']}"):
            os._exit(1)
        if os.path.exists(f"{folder}.failing{prompt['user']}"):
            raise ValueError("busy")
        return prompt["user"]
    return answer


def asked(folder):
    return {name: os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder)}


@pytest.fixture
def note(folder):
    os.makedirs(f"{folder}/notes")
    return f"{folder}/notes"


def test_a_run_that_dies_loses_one_wave(spark, folder, note):
    prompts, path = prompts_of(spark, 60, note), f"{folder}/waves"
    fatal = open(f"{note}.fatal7", "w")
    fatal.close()
    with pytest.raises(PySparkException):
        infer_in_waves(prompts, counting_model, path, 10, 1)
    before = asked(note)
    stored = spark.read.parquet(f"{path}/replies").count() if os.path.exists(
        f"{path}/replies") else 0
    os.remove(fatal.name)
    again = infer_in_waves(prompts, counting_model, path, 10, 1)
    assert rows(again.select("dataset", "raw", "error")) == sorted(
        ((f"d{i}", str(i), None) for i in range(60)), key=repr)
    twice = [k for k, n in asked(note).items() if n > 1]
    assert "7" in twice and len(twice) <= len(before) - stored and len(twice) < 20
    # nothing is asked again
    done = asked(note)
    infer_in_waves(prompts, counting_model, path, 10, 1)
    assert asked(note) == done


def test_waves_ask_again_what_failed(spark, folder, note):
    path = f"{folder}/waves"
    failing = open(f"{note}.failing3", "w")
    failing.close()
    first = infer_in_waves(prompts_of(spark, 20, note), counting_model, path, 6)
    assert rows(first.where("error is not null").select("dataset", "error")) == [
        ("d3", "ValueError: busy")]
    os.remove(failing.name)
    more = infer_in_waves(prompts_of(spark, 25, note), counting_model, path, 6)
    assert more.where("error is null").count() == 25
    assert {k for k, n in asked(note).items() if n > 1} == {"3"}
    same = infer(prompts_of(spark, 25, note), counting_model, f"{folder}/plain")
    assert rows(same) == rows(more)
    assert infer_in_waves(prompts_of(spark, 0, note), counting_model, path, 6).count() == 0


# ---- streams and evaluations

def test_a_stream_of_datasets_equals_the_batch(spark, listed, folder):
    plans = row_plans(listed, keyword_method())
    arriving = f"{folder}/in"
    listed.where("row_id < 3").coalesce(1).write.parquet(arriving)
    for _ in range(2):
        stream = spark.readStream.schema(listed.schema).parquet(arriving)
        standardize_catalog_stream(
            stream, plans, f"{folder}/out", f"{folder}/progress").awaitTermination()
        listed.where("row_id = 3").coalesce(1).write.mode("append").parquet(arriving)
    got = spark.read.parquet(f"{folder}/out")
    assert got.select("batch").distinct().count() == 2
    want = apply_rows(listed, plans)
    text = [c if c != "fields" else F.to_json(c).alias(c) for c in want.columns]
    assert rows(got.select(*text)) == rows(want.select(*text))


def gt_of(spark, second="good"):
    return spark.createDataFrame([
        ("a", 1, '{"text": "x", "label": "1"}'), ("b", 1, f'{{"text": "{second}"}}')],
        "dataset string, row_id long, task_data string")


def test_only_changed_datasets_are_evaluated(spark, listed, folder):
    seen = []

    def method(columns, samples):
        seen.append(sorted(r[0] for r in columns.select("dataset").distinct().collect()))
        return keyword_match(columns)

    def run(name, gt, data=listed, **how):
        found = run_evaluation_changed(data, gt, {"keyword": method}, f"{folder}/kept", name, **how)
        return sorted((r["dataset"], r["run"]) for r in found.collect())

    assert run("1", gt_of(spark)) == [("a", "1"), ("b", "1")]
    assert run("2", gt_of(spark).repartition(3), listed.repartition(2)) == [("a", "1"), ("b", "1")]
    assert run("3", gt_of(spark, "it's")) == [("a", "1"), ("b", "3")]
    assert run("4", gt_of(spark, "it's"), listed.where("dataset = 'a'")) == [("a", "1")]
    assert seen == [["a", "b"], ["b"]]
    assert run("5", gt_of(spark, "it's"), settings="other") == [("a", "5"), ("b", "5")]


def test_digests_tell_rows_apart(spark, listed):
    one = dict(content_digests(listed, gt_of(spark)).collect())
    assert one == dict(content_digests(listed.repartition(4), gt_of(spark)).collect())
    twice = dict(content_digests(listed.union(listed.where("row_id = 1 and dataset = 'a'")),
                                 gt_of(spark)).collect())
    assert twice["a"] != one["a"] and twice["b"] == one["b"]
    assert dict(content_digests(listed, gt_of(spark), "x").collect())["a"] != one["a"]


def test_a_method_that_raises_for_one_dataset(spark, listed):
    def mine(names, samples):
        if "sentence" in names:
            raise KeyError("sentence")
        return {"text": "text", "label": "label"}

    results = run_evaluation(
        listed.where("row_id = 1"), gt_of(spark), {"mine": function_method(mine, "mine"), "keyword": keyword_method()})
    got = {(r["dataset"], r["method"]): (r["score"], r["error"]) for r in results.collect()}
    assert got["b", "mine"] == (None, "KeyError: 'sentence'") and got["a", "mine"] == (1.0, None)
    table = {r["dataset"]: r for r in score_table(results).collect()}
    assert table["Average"]["mine"] == 1.0 and table["b"]["mine"] is None
    with pytest.raises(PySparkException):
        score_table(results.union(results)).collect()


# ---- splits

def test_a_corrupt_split_is_passed_over_with_a_schema(spark, folder):
    spark.range(3).write.parquet(f"{folder}/root/ds/test")
    spark.range(3).selectExpr("cast(id as string)").write.text(f"{folder}/root/ds/train")
    assert load_split(spark, f"{folder}/root", "ds", schema="id long").count() == 3
    assert load_split(spark, f"file://{folder}/root", "ds").count() == 3
    with pytest.raises(ValueError):
        load_split(spark, f"{folder}/root", "none")
    picked = load_rows(spark, f"{folder}/root", "ds", limit=2)
    assert rows(picked) == [(0,), (1,)]
