"""Finding the mapping in a reply; expected values worked out by hand."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colmap.functions.json_text import (
    _outside,
    _thought,
    entries_column,
    lenient,
    mapping_in,
    strict,
)
from colmap.operators.responses import extract, fill_missing, parse_responses
from colmap.streaming.standardize import extract_stream, read_stream, write_stream
from tests.conftest import rows

OBJ = '{"task": "c", "text": "x"}'
MAP = {"task": "c", "text": "x"}


@pytest.mark.parametrize("text, want", [
    (OBJ, MAP),
    (f"Sure!\n```json\n{OBJ}\n```", MAP),
    (f"```\n{OBJ}\n```", MAP),
    (f"<think>hm</think>{OBJ}", MAP),
    (f"<think>hm {OBJ}</think>", MAP),
    (f"<think>hm {OBJ}", MAP),  # never closed: found in the whole text
    ('{"task":"c","text"_a":"x"}', {"task": "c", "text_a": "x"}),
    ('{x} {"task":"c"}', None),  # only the first brace counts
    ('{"task":"a}b"}', {"task": "a}b"}),
    ('{"task":"a\\"}b"}', {"task": 'a"}b'}),
    ('{"task": {"k": {}}} {"task": 2}', {"task": {"k": {}}}),
    ("<think>{x}</think>" + OBJ, MAP),  # the first two places fail, the third does not
    ("{}", {}),
    ("{} " + OBJ, {}),
    ('{"task": "c"', None),
    ("no object", None),
    ("", None),
    # a fence that does not parse gives way to the first brace of the same text
    ('```json\n{"task" "c"}\n```' + OBJ, None),
    ('{"a": 1} ```json\n{"task": "c"}\n```', {"task": "c"}),  # fences go first
    ("<think>a</think><think>{\"task\": 1}</think>", {"task": 1}),
    ("<think>{x</think> y <think>" + OBJ, None),  # an open block is cut off
    ('[{"task": "c"}]', {"task": "c"}),
])
def test_strict(text, want):
    assert strict(text) == want


@pytest.mark.parametrize("text, want", [
    (OBJ, MAP),
    (f"a ```json {OBJ} ``` b", MAP),
    (f"a ``` {OBJ} ``` b", MAP),
    (f"```x\n{OBJ}\n```", MAP),  # language tag other than json: by the braces
    (f"so: {OBJ} done", MAP),
    (f"``` none ``` ```json {OBJ}```", MAP),  # the json fence goes first
    (f"``` none ``` {OBJ}", None),  # only the first fence's inside is read
    (f"{{x}} {OBJ}", None),  # from the first to the last brace
    ("} {", None),
    ("", None),
    ("[1, 2]", [1, 2]),
    ("{}", {}),
])
def test_lenient(text, want):
    assert lenient(text) == want


@pytest.mark.parametrize("text, inside, outside", [
    ("a<think>b</think>c", "b", "ac"),
    ("a<think>b", "", "a"),
    ("a</think>b", "", "a</think>b"),
    ("<think>a</think>b<think>c</think>d<think>e", "a", "bd"),
    ("<think>a<think>b</think>c</think>d", "a<think>b", "c</think>d"),
    ("<thi<think>x</think>nk>y", "x", ""),  # what is left can open a block
    ("plain", "", "plain"),
])
def test_think_blocks(text, inside, outside):
    assert (_thought(text), _outside(text)) == (inside, outside)


@pytest.mark.parametrize("raw", [None, "", "{}", '{"text": "x"}', '["task"]', '"task"', "{" * 5000])
@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_unusable(raw, mode):
    assert mapping_in(raw, mode) is None


def test_deep_object_is_unusable():
    deep = '{"task":' * 100000 + "1" + "}" * 100000
    assert mapping_in(deep, "strict") is None


def test_entry_values():
    text = '{"task": "c", "classes": ["a", "é"], "n": 1.5, "x": null, "y": "\\ud800"}'
    none, got, plain = entries_column("strict")(pa.array([None, text, OBJ])).to_pylist()
    assert none is None and [e["pos"] for e in plain] == [0, 1]
    assert [(e["field"], e["value"], e["is_string"], e["value_json"]) for e in got] == [
        ("task", "c", True, '"c"'),
        ("classes", None, False, '["a", "é"]'),
        ("n", None, False, "1.5"),
        ("x", None, False, "null"),
        ("y", "�", True, '"�"'),
    ]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=3), inner, max_size=3),
    max_leaves=6), max_size=4), st.text(alphabet="ab }]\n", max_size=10))
def test_object_is_found_whatever_follows(value, rest):
    from colmap.functions.json_text import _object_in

    assert _object_in("say " + json.dumps(value) + rest) == value


def test_table(spark):
    raw = spark.createDataFrame(
        [("a", "m", "local", OBJ, None), ("b", "m", "local", "none", None),
         ("c", "m", "local", None, "boom")],
        "dataset string, method string, backend string, raw string, error string")
    got = parse_responses(raw, "local")
    assert rows(got.select("dataset", "task", "status", "code")) == [
        ("a", "c", "ok", "Rename(field='x', to_field='text')"),
        ("b", None, "failed", "# Error: local LLM failed"),
        ("c", None, "failed", "# Error: local LLM failed"),
    ]
    known = spark.createDataFrame([("a",), ("d",)], "dataset string")
    filled = fill_missing(got, known, "m").where("dataset = 'd'")
    assert rows(filled.selectExpr("dataset", "size(entries)", "code")) == [
        ("d", 0, "# Error: no features")]


def test_stream_equals_batch(spark, folder):
    df = spark.range(200).selectExpr(
        "id", f"case when id % 3 = 0 then concat('x ', '{OBJ}') else 'none' end as raw")
    df.write.parquet(f"{folder}/in")
    stream = read_stream(spark, f"{folder}/in", df.schema)
    write_stream(extract_stream(stream), f"{folder}/out", f"{folder}/progress").awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/out")) == rows(extract(df))
