"""Ground truth from values, names and specs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colmap.functions.exprs import first_rows
from colmap.operators.schema import catalog, column_sets, columns_of_rows
from colmap.operators.specs import inspection, spec_entries, spec_truth
from colmap.operators.truth import (
    expand_task_data,
    first_fields,
    overlap_frames,
    overlap_records,
    task_data_cells,
    truth_cells,
    truth_columns,
    unreadable_datasets,
    with_name_fallback,
)
from tests.conftest import rows


def gt_frame(spark, records):
    return spark.createDataFrame(
        [(i, json.dumps(r)) for i, r in enumerate(records)], "row_id long, task_data string")


def matched(df):
    return {r["field"]: (r["col"], r["hits"], r["n_gt"]) for r in df.collect()}


def test_expand(spark):
    gt = gt_frame(spark, [{"b": 1, "metadata": {"x": 1}}, {"a": "t", "b": None},
                          {"c": [1, 2], "data_classification_policy": ["p"]}])
    got = expand_task_data(gt, "row_id")
    assert got.columns == ["b", "a", "c"]
    assert rows(got) == sorted([("1", None, None), (None, "t", None), (None, None, "[1,2]")], key=repr)
    assert expand_task_data(gt.select("row_id"), "row_id").columns == []
    assert rows(task_data_cells(gt).select("row_id", "field")) == [
        (0, "b"), (1, "a"), (1, "b"), (2, "c")]


def test_expand_made_up_keys(spark):
    gt = spark.range(6000).selectExpr(
        "id as row_id", "concat('{\"k', id, '\": 1}') as task_data")
    assert expand_task_data(gt, "row_id", keys=["k7", "none"]).where("k7 = '1'").count() == 1
    assert len(expand_task_data(gt.where("row_id < 300"), "row_id").columns) == 300
    assert task_data_cells(gt).count() == 6000


def test_only_objects_are_records(spark):
    bad = ["{'a': 'x'}", '{"a": "x"} y', '{"a": "x"}{"a": 2}', '{"a": "x"', "[1]", '{"a":1},{"a":2}']
    gt = spark.createDataFrame([("d", i, t) for i, t in enumerate(['{"a": "x"}', None] + bad)],
                               "dataset string, row_id long, task_data string")
    raw = spark.createDataFrame([("d", 0, '{"p": "x", "a": 2}')],
                                "dataset string, row_id long, row string")
    assert task_data_cells(gt).count() == 1
    found = overlap_records(raw, gt, None).collect()
    assert [(r["field"], r["n_gt"], r["col"]) for r in found] == [("a", 1, "p")]
    assert unreadable_datasets(truth_cells(gt)).count() == 1
    assert unreadable_datasets(truth_cells(gt.where("row_id < 2"))).count() == 0


def test_first_fields(spark):
    gt = gt_frame(spark, [{"b": 1, "metadata": 1, "a_type": 2}, {"z": 1}]).withColumn(
        "dataset", F.lit("d"))
    assert rows(first_fields(gt).select("pos", "field")) == [(0, "b"), (2, "a_type")]


def test_floor_and_column_order(spark):
    raw = spark.createDataFrame(
        [(1, "a", "a"), (2, "x", "b"), (3, "y", "c")], "id long, p string, q string")
    gt = gt_frame(spark, [{"t": "a", "i": 1, "u": "n1", "v": None, "w_type": "a"},
                          {"t": "b", "i": 2, "u": "n2", "v": None},
                          {"t": "c", "i": 9, "u": "n3", "v": None}])
    got = matched(overlap_frames(raw, gt, "d", 10))
    assert got == {
        "t": ("p", 1, 3),  # 3 values need 1 hit; p comes before q
        "i": ("id", 2, 3),
        "u": (None, 0, 3),
        "v": (None, 0, 0),
    }


def test_n_limits_both_sides(spark):
    raw = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id long, p string")
    gt = gt_frame(spark, [{"t": f"v{i}"} for i in range(19, -1, -1)])
    assert matched(overlap_frames(raw, gt, "d", 10)) == {"t": (None, 0, 10)}
    assert matched(overlap_frames(raw, gt, "d", None)) == {"t": ("p", 20, 20)}


def test_types_meet_as_text(spark):
    raw = spark.sql("""select 1L as k, 1.5D as d, cast(2.50 as decimal(10,2)) as m, true as b,
        timestamp'2024-01-02 03:04:05' as ts, timestamp_ntz'2024-01-02 03:04:05' as nt,
        date'2024-01-02' as dt, array(1, 2) as ar, named_struct('x', 1) as st, 1e-7D as tiny,
        cast('abc' as binary) as bi, map('k', 1) as mp""")
    gt = raw.select("k", F.to_json(F.struct(*[F.col(c).alias(f"g_{c}") for c in raw.columns]))
                    .alias("task_data"))
    got = matched(overlap_frames(raw, gt, "d", None))
    assert {f: c[0] for f, c in got.items()} == {f"g_{c}": c for c in raw.columns}


def test_wide_table(spark):
    names = [f"c{i}" for i in range(150)]
    raw = spark.createDataFrame([(7, *[f"v{i}" for i in range(150)])],
                                "id long, " + ", ".join(f"{c} string" for c in names))
    gt = gt_frame(spark, [{f"f{i}": f"v{149 - i}" for i in range(150)}])
    got = matched(overlap_frames(raw, gt, "d", None))
    assert all(got[f"f{i}"] == (f"c{149 - i}", 1, 1) for i in range(150))


def test_long_values_match_whole(spark):
    same, other = "x" * 5000, "x" * 4999 + "y"
    raw = spark.createDataFrame([(1, other, same)], "id long, p string, q string")
    assert matched(overlap_frames(raw, gt_frame(spark, [{"t": same}]), "d", None)) == {
        "t": ("q", 1, 1)}


def brute(raw, gt, n):
    """Matches of one dataset, straight from the definition."""
    raw, gt = (raw, gt) if n is None else (raw[:n], gt[:n])
    cols = list(dict.fromkeys(c for r in raw for c in r))
    out = {}
    for field in gt[0]:
        if field == "metadata" or field.endswith("_type"):
            continue
        want = {str(r[field]) for r in gt if r.get(field) is not None}
        out[field] = (None, 0, len(want))
        for col in cols:
            have = {str(r[col]) for r in raw if r.get(col) is not None}
            if want and len(want & have) >= max(1, len(want) // 2):
                out[field] = (col, len(want & have), len(want))
                break
    return out


@pytest.mark.parametrize("n", [10, None])
def test_records_against_brute_force(spark, n):
    rng = random.Random(5)
    raw, gt = {}, {}
    for d in range(12):
        names = rng.sample(["a", "b", "c", "d", "e"], rng.randint(1, 4))
        size = 400 if d == 0 else rng.randint(1, 30)  # one dataset has most rows

        def value():
            return rng.choice([None, rng.randint(0, 12), f"s{rng.randint(0, 12)}", "hot"])

        raw[f"d{d}"] = [
            {c: value() for c in names if rng.random() < 0.9} for _ in range(size)]
        gt[f"d{d}"] = [
            {**{f: value() for f in ("f", "g", "h")}, "metadata": 1, "x_type": "hot"}
            for _ in range(rng.randint(1, 40))]
    frame = lambda data, name: spark.createDataFrame(
        [(d, i, json.dumps(r)) for d, rs in data.items() for i, r in enumerate(rs)],
        f"dataset string, row_id long, {name} string").repartition(9)
    raw_df, gt_df = frame(raw, "row"), frame(gt, "task_data")
    found = overlap_records(raw_df, gt_df, n)
    got = {}
    for r in found.collect():
        got.setdefault(r["dataset"], {})[r["field"]] = (r["col"], r["hits"], r["n_gt"])
    assert got == {d: brute(raw[d], gt[d], n) for d in raw}


def test_typed_and_schemaless_agree(spark):
    raw = spark.range(300).selectExpr("id", "concat('t', id % 40) as p", "id % 7 as q")
    gt = raw.selectExpr(
        "id as row_id", "to_json(named_struct('text', p, 'n', q, 'id', id, 'no', 'x')) as task_data")
    typed = overlap_frames(raw, gt, "d", None)
    packed = raw.selectExpr("'d' as dataset", "id as row_id", "to_json(struct(*)) as row")
    loose = overlap_records(packed, gt.withColumn("dataset", F.lit("d")), None)
    assert matched(typed) == matched(loose)


@pytest.mark.parametrize("cols, field, want", [
    (["x", "label"], "label", "label"),
    (["target", "labels"], "label", "labels"),  # order of the list, not of the columns
    (["class", "target"], "answer", "target"),
    (["x"], "label", None),
    (["target"], "text", None),
    (["text"], "text", "text"),
])
def test_name_fallback(spark, cols, field, want):
    matches = spark.createDataFrame(
        [("d", field, 0, 1, None, 0)],
        "dataset string, field string, pos int, n_gt long, col string, hits long")
    sets = spark.createDataFrame([("d", cols)], "dataset string, cols array<string>")
    got = with_name_fallback(matches, sets)
    assert got.first()["col"] == want
    assert truth_columns(got).first()["gt_cols"] == ([want] if want else [])


def spec(spark, fields, cols=None):
    df = spec_entries(
        spark.createDataFrame([("d", json.dumps(fields))], "dataset string, spec string"))
    sets = None
    if cols is not None:
        sets = spark.createDataFrame([("d", cols)], "dataset string, cols array<string>")
    got = spec_truth(df, sets).first()
    return {e["field"]: e["value"] for e in got["truth"]}, got["gt_cols"], got["structure"]


def test_spec_rules(spark):
    assert spec(spark, {"labels": "label", "sentence1": "premise", "sentence2": "hyp"}) == (
        {"sentence1": "premise", "sentence2": "hyp", "labels": "label"},
        ["hyp", "label", "premise"], "paired")
    assert spec(spark, {"sentence1": "sentence1"}, ["sentence1"])[0] == {"sentence1": "sentence1"}
    assert spec(spark, {"sentence1": "sentence1"}, ["x"])[0] == {}
    assert spec(spark, {"sentence1": "sentence1"})[0] == {}
    assert spec(spark, {"inputs": "inputs"})[0] == {"inputs": "inputs"}  # its default is "input"
    assert spec(spark, {"inputs": "input"}, ["input"])[0] == {"inputs": "input"}
    assert spec(spark, {"choice1": "b", "choices": "z", "choice0": 3, "other": "x", "labels": 1})[0] == {
        "choice1": "b", "choices": "z"}


def test_inspection(spark):
    specs = spark.createDataFrame(
        [(f"t{i}", f"t{i}", "Classification", '{"sentence1": "s", "labels": "y"}') for i in (3, 1, 2)],
        "id string, dataset string, task_type string, spec string")
    sets = spark.createDataFrame([("t1", ["y", "s"])], "dataset string, cols array<string>")
    got = inspection(spec_truth(spec_entries(specs), sets), 2).collect()
    assert [tuple(r) for r in got] == [
        ("t1", "Classification/single", "sentence1←s  labels←y", "{s, y}"),
        ("t2", "Classification/single", "sentence1←s  labels←y", "(unavailable)"),
    ]


def test_first_rows_ranks_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id")
    plan = first_rows(df, "g", ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert rows(first_rows(df.repartition(20), "g", ["id"], 2).select("g", "id", "rn")) == [
        (0, 0, 1), (0, 3, 2), (1, 1, 1), (1, 4, 2), (2, 2, 1), (2, 5, 2)]


def test_catalog_columns_feed_fallback(spark):
    df = spark.createDataFrame([(1, "x")], "id long, target string")
    sets = column_sets(catalog(spark, {"d": df}))
    assert sets.first()["cols"] == ["id", "target"]
    assert columns_of_rows(df.selectExpr("'d' as dataset", "id as row_id", "to_json(struct(*)) as row")
                           ).count() == 2
