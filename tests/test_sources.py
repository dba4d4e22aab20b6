"""Opening datasets, cards, registries, sinks."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from colmap.functions.exprs import card_family, card_id
from colmap.plans.evaluation import evaluate_dataset, evaluate_spec_dataset
from colmap.plans.methods import keyword_method
from colmap.plans.standardize import (
    baseline_keyword_match,
    load_standardized_dataset,
    load_standardized_dataset_local,
)
from colmap.session import scratch_path, written
from colmap.sources.cards import discover, read_cards, write_cards
from colmap.sources.registry import dataset_id, discover_tasks, fixed_registry, seeded_sample
from colmap.sources.sinks import read_csv, write_csv, write_table
from colmap.sources.splits import load_rows, load_split, raw_columns
from tests.conftest import rows
from workload.queries import keyword_model


def put(spark, path, value):
    spark.createDataFrame([(value, 1)], "text string, label int").coalesce(1).write.parquet(path)


def opened(df):
    return df.first()["text"]


def test_split_order(spark, folder):
    put(spark, f"{folder}/both/test", "test")
    put(spark, f"{folder}/both/train", "train")
    put(spark, f"{folder}/late/validation", "validation")
    put(spark, f"{folder}/mid/test", "test")
    put(spark, f"{folder}/mid/validation", "validation")
    assert opened(load_split(spark, folder, "both")) == "train"
    assert opened(load_split(spark, folder, "late")) == "validation"
    assert opened(load_split(spark, folder, "mid")) == "test"


def test_file_layouts(spark, folder):
    put(spark, f"{folder}/one.parquet", "unsplit")
    put(spark, f"{folder}/two/test.parquet", "test file")
    put(spark, f"{folder}/three/train-00000-of-00001.parquet", "shard")
    put(spark, f"{folder}/four/data.parquet", "inside")
    assert opened(load_split(spark, folder, "one")) == "unsplit"
    assert opened(load_split(spark, folder, "two")) == "test file"
    assert opened(load_split(spark, folder, "three")) == "shard"
    assert opened(load_split(spark, folder, "four")) == "inside"


def test_config(spark, folder):
    put(spark, f"{folder}/d/beta/train", "beta train")
    put(spark, f"{folder}/d/alpha/test", "alpha test")
    put(spark, f"{folder}/own/x/train", "x")
    put(spark, f"{folder}/own/train", "own")
    assert opened(load_split(spark, folder, "d")) == "alpha test"  # first config by name
    assert opened(load_split(spark, folder, "d", "beta")) == "beta train"
    assert opened(load_split(spark, folder, "own")) == "own"


def test_other_formats(spark, folder):
    os.makedirs(f"{folder}/c")
    with open(f"{folder}/c/test.csv", "w") as f:
        f.write("text,label\nhi,1\n")
    assert opened(load_split(spark, folder, "c", fmt="csv", header="true")) == "hi"
    os.makedirs(f"{folder}/j")
    with open(f"{folder}/j/train.json", "w") as f:
        f.write('{"text": "yo"}\n')
    assert opened(load_split(spark, folder, "j", fmt="json", schema="text string")) == "yo"


def test_missing(spark, folder):
    with pytest.raises(ValueError, match="No accessible split for nope/x: "):
        load_split(spark, folder, "nope", "x")
    assert raw_columns(spark, folder, "nope") == set()
    put(spark, f"{folder}/d/test", "t")
    assert raw_columns(spark, folder, "d") == {"text", "label"}


def test_limit(spark, folder):
    spark.range(50).write.parquet(f"{folder}/d/train")
    assert load_rows(spark, folder, "d", limit=7).count() == 7
    assert load_rows(spark, folder, "d").count() == 50


CARD = {"__type__": "task_card", "loader": {"__type__": "load_hf", "path": "p", "name": "c"},
        "task": "tasks.qa"}


def card(folder, path, body):
    full = f"{folder}/{path}"
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body, indent=2))


def test_cards(spark, folder):
    card(folder, "one/cards/a.json", CARD)
    card(folder, "one/cards/g/h/b.json", {**CARD, "task": "tasks.classification.multi_class.relation"})
    card(folder, "one/cards/dot.v1.json", {**CARD, "loader": {"__type__": "load_hf", "path": "q"}})
    card(folder, "one/cards/notes.txt", "x")
    card(folder, "one/cards/bad.json", "{not json")
    card(folder, "one/cards/tail.json", json.dumps(CARD) + " x")
    card(folder, "one/cards/other.json", {**CARD, "__type__": "other"})
    card(folder, "one/cards/csv.json", {**CARD, "loader": {"__type__": "load_csv", "path": "p"}})
    card(folder, "one/cards/noload.json", {"__type__": "task_card", "task": "qa"})
    card(folder, "one/cards/object.json", {**CARD, "task": {"qa": 1}})
    card(folder, "one/cards/list.json", {**CARD, "task": ["qa"]})
    card(folder, "one/cards/none.json", {**CARD, "task": None})
    card(folder, "one/cards/again.json", {**CARD, "task": "tasks.regression"})
    card(folder, "two/cards/a.json", {**CARD, "task": "tasks.generation"})
    card(folder, "two/cards/again.json", {**CARD, "task": "tasks.translation"})
    got = discover(read_cards(spark, [f"{folder}/one", f"{folder}/two"]))
    assert rows(got) == [
        ("a", "p", "c", "qa"),
        ("again", "p", "c", "generation"),  # the first copy matches no family
        ("dot.v1", "q", None, "qa"),
        ("g.h.b", "p", "c", "nli"),
    ]


@pytest.mark.parametrize("task, wanted, family", [
    ("tasks.classification.binary", None, "classification"),
    ("tasks.classification.multi_class.relation", None, "nli"),
    ("qa_generation", None, "qa"),
    ("qa_generation", ["generation", "qa"], "generation"),
    ("tasks.summarization", ["nli"], None),
    ("tasks.QA", None, None),
    ("x", ["unknown"], None)])
def test_card_family(spark, task, wanted, family):
    assert spark.range(1).select(card_family(F.lit(task), wanted)).first()[0] == family


def test_card_id(spark):
    for path, want in [("a/b.json", "a.b"), ("a.b.json", "a.b"), ("cards/z.json", "cards.z")]:
        assert spark.range(1).select(card_id(F.lit(path))).first()[0] == want


def test_many_copies_of_a_card(spark):
    body = json.dumps(CARD)
    raw = spark.range(20000).select(
        F.lit(0).alias("catalog_pos"),
        F.expr("concat('', if(id % 3 = 0, 'hot', string(id)), '.json')").alias("path"),
        F.lit(body).alias("body"))
    assert discover(raw.repartition(20)).count() == 20000 - 6667 + 1


def test_registries(spark):
    assert rows(fixed_registry(spark))[0] == ("mnli", "glue", "mnli")
    tasks = spark.createDataFrame(
        [("a", "n", float("nan"), "Classification", "m"), ("b", "n", 2.0, "Other", "m")],
        "id string, dataset_name string, config_name double, task_type string, mapping string")
    assert rows(discover_tasks(tasks)) == [("a", "n", None, "Classification", "m")]
    ids = spark.createDataFrame([("n", "c"), ("n", None)], "name string, config string").select(
        dataset_id(F.col("name"), F.col("config")))
    assert rows(ids) == [("n",), ("n/c",)]


def test_sample_is_the_same_for_a_seed(spark):
    df = spark.range(500).select(F.concat(F.lit("d"), "id").alias("id"))
    first = rows(seeded_sample(df.repartition(3), "id"))
    assert first == rows(seeded_sample(df.repartition(31), "id")) and len(first) == 20
    assert first != rows(seeded_sample(df, "id", seed=43))
    assert seeded_sample(df.limit(5), "id").count() == 5


def test_csv_keeps_text(spark, folder):
    df = spark.createDataFrame(
        [('a "quoted", \\ line\nbreak', 1, ["x"]), ("ünï", None, None)],
        "t string, n int, l array<string>")
    write_csv(df, f"{folder}/csv")
    back = read_csv(spark, f"{folder}/csv", "t string, n int, l string")
    assert rows(back) == rows(df.withColumn("l", F.to_json("l")))
    write_table(df, f"{folder}/table")
    assert rows(spark.read.parquet(f"{folder}/table")) == rows(df)


def test_scratch_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared)
    assert written(spark.range(5), "five").count() == 5


def test_scratch_without_a_shared_folder():
    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default),
                               sparkContext=SimpleNamespace(master=master))

    a, b = (scratch_path(session("local[2]"), "x") for _ in range(2))
    assert a != b and os.path.dirname(a) == os.path.dirname(b)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(session("spark://host:7077"), "x")


def test_by_name(spark, folder):
    put(spark, f"{folder}/d/test", "t")
    spark.createDataFrame([(1, '{"text": "t", "label": "good"}')], "id long, task_data string"
                          ).write.parquet(f"{folder}/gt/card1/validation")
    got = evaluate_dataset(spark, folder, "d", None, "card1", f"{folder}/gt", keyword_method())
    assert got["dataset"] == "card1" and got["score"] == 1.0
    with pytest.raises(ValueError, match="No accessible split"):
        evaluate_dataset(spark, folder, "d", None, "card2", f"{folder}/gt", keyword_method())
    spec = evaluate_spec_dataset(spark, folder, "d", None, {"labels": "label"}, keyword_method())
    assert spec["score"] == 0.5
    for load in (load_standardized_dataset, load_standardized_dataset_local):
        out = load(spark, folder, "d", factory=keyword_model, model_id="m")
        assert out["mapping"] == {"text": "text", "label": "label", "task": "classification"}
        assert out["score"] == 0.1 and out["code"] == "# No rename steps needed"
    assert baseline_keyword_match(spark, "d", root=folder)["mapping"]["text"] == "text"


def test_corrupt_split_is_passed_over(spark, folder):
    os.makedirs(f"{folder}/d")
    with open(f"{folder}/d/train.parquet", "wb") as f:
        f.write(b"PAR1 not a table")
    put(spark, f"{folder}/d/test", "test")
    assert opened(load_split(spark, folder, "d")) == "test"
    with pytest.raises(ValueError, match="No accessible split"):
        load_split(spark, folder, "none")


def test_cards_of_odd_roots(spark, folder):
    """A root below a folder named cards, names with spaces and signs, a missing root."""
    card(folder, "cards/one/cards/my card.json", CARD)
    card(folder, "cards/one/cards/cards/a+b%20.json", CARD)
    card(folder, "two/cards/my card.json", CARD)
    os.makedirs(f"{folder}/empty")
    raw = read_cards(spark, [f"{folder}/cards/one", f"{folder}/empty", f"{folder}/two/"])
    assert rows(raw.select("catalog_pos", "path")) == [
        (0, "cards/a+b%20.json"), (0, "my card.json"), (2, "my card.json")]
    assert rows(discover(raw, []).select("card_id")) == [("cards.a+b%20",), ("my card",)]
    assert read_cards(spark, [f"{folder}/empty"]).count() == 0


def test_written_cards(spark, folder):
    """A file for every row, copies too, and no folder that holds them all."""
    bodies = spark.range(1200).select(F.when(F.col("id") < 1199, F.to_json(F.struct(
        F.lit("é\n").alias("task"), (F.col("id") % 400).alias("n")))).alias("b"))
    assert write_cards(bodies, f"{folder}/one/cards") == 1199
    assert write_cards(bodies, f"file://{folder}/two/cards/") == 1199
    assert write_cards(bodies.limit(0), f"{folder}/three/cards") == 0
    raw = read_cards(spark, [f"{folder}/one", f"{folder}/two", f"{folder}/three"])
    assert raw.select("path").distinct().count() == 2 * 1199
    for pos in (0, 1):
        found = raw.where(F.col("catalog_pos") == pos)
        assert rows(found.select(F.rtrim(F.regexp_replace("body", r"\n$", "")))) == rows(
            bodies.where("b is not null"))
    assert len(os.listdir(f"{folder}/one/cards")) == 5
