"""Applying mappings, rename plans, streams."""

import pytest
from pyspark.sql import functions as F

from colmap.functions.exprs import entries_from_json, mapping_json, rename_plan
from colmap.operators.apply import apply_mapping, resolve
from colmap.streaming.standardize import read_stream, standardize_stream, write_stream
from tests.conftest import SMALL, rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, "one", 0, True), (2, "two", 1, False), (3, "three", 9, None), (4, None, None, True),
         (5, "five", -1, True)],
        "id long, body string, target int, flag boolean")


def test_projection_reads_only_what_is_mapped(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = apply_mapping(docs, {"task": "c", "text": "text", "origin": "source"}).where(
        "origin = 'src1'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,source:string>" in plan
    assert "EqualTo(source,src1)" in plan


def test_order_and_constants(table):
    got = apply_mapping(table, {
        "label": "target", "task": "c", "text": "body", "text_type": "body", "tone": "warm",
        "number": 7, "type_of_class": "target"})
    assert got.columns == ["label", "text", "text_type", "tone", "type_of_class"]
    assert rows(got)[0] == (-1, "five", "body", "warm", "target")


def test_last_field_on_a_column_wins_in_first_place(table):
    got = apply_mapping(table, {"text": "body", "id": "id", "label": "body"})
    assert got.columns == ["label", "id"]


def test_decode(table):
    got = apply_mapping(table, {"label": "target", "classes": ["no", "yes"]})
    assert rows(got.select("label")) == sorted(
        [("no",), ("yes",), ("9",), (None,), ("-1",)], key=repr)
    assert {r["classes"] for r in got.collect()} == {"['no', 'yes']"}


def test_decode_boolean_and_text(table):
    flags = apply_mapping(table, {"label": "flag", "classes": ["no", "yes"]})
    assert [r["label"] for r in flags.collect()] == ["yes", "no", None, "yes", "yes"]
    text = apply_mapping(table, {"label": "body", "classes": ["no", "yes"]})
    assert text.first()["label"] == "one"


def test_empty_classes_are_no_classes(table):
    got = apply_mapping(table, {"label": "target", "classes": []})
    assert got.columns == ["label"] and dict(got.dtypes)["label"] == "int"


def test_names_are_exact(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A int, `x.y` int")
    assert apply_mapping(df, {"f": "A", "g": "x.y"}).first().asDict() == {"f": 2, "g": 3}
    assert apply_mapping(spark.createDataFrame([(1,)], "a int"), {"f": "A"}).first().asDict() == {"f": "A"}


def test_nothing_mapped(table):
    got = apply_mapping(table, {"task": "c"})
    assert got.columns == [] and got.count() == 5


def test_resolve_is_by_key_first():
    out = resolve({"text_type": "body", "label": "positive", "text": "body", "task": "body"}, ["body"])
    assert out.renames == {"body": "text"}
    assert out.constants == {"text_type": "body", "label": "positive"}


@pytest.mark.parametrize("mapping, want", [
    ("{}", "# Mapping failed"),
    ('{"task": "t", "text": "text"}', "# No rename steps needed"),
    ('{"task": "t"}', "# No rename steps needed"),
    ('{"task": "t", "text": "a", "classes": ["x"], "label": "b"}',
     "Rename(field='a', to_field='text'), Rename(field='b', to_field='label')"),
])
def test_rename_plan(spark, mapping, want):
    got = spark.createDataFrame([(mapping,)], "m string").select(
        rename_plan(entries_from_json(F.col("m"))))
    assert got.first()[0] == want


def test_mapping_json_round_trip(spark):
    text = '{"task": "t", "a\\"b": "é\\n", "classes": ["x",1], "n": null}'
    got = spark.createDataFrame([(text,)], "m string").select(
        mapping_json(entries_from_json(F.col("m")))).first()[0]
    assert got == text


def test_rows_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert apply_mapping(docs, {"text": "text"}).count() == docs.count()


def test_stream_equals_batch(spark, folder):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    mapping = {"id": "event_id", "label": "user_id", "classes": ["a", "b", "c"], "kind_type": "x"}
    stream = read_stream(spark, f"{SMALL}/events.parquet*", events.schema)
    write_stream(standardize_stream(stream, mapping), f"{folder}/out", f"{folder}/progress"
                 ).awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/out")) == rows(apply_mapping(events, mapping))
