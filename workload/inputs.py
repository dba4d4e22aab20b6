"""Inputs of the registered queries, all derived by Spark from the given tables.

``records`` is the main one: every document as a JSON row of a dataset named
``source/lang``, with column names that depend on the source, the way collected
datasets name theirs. ``reference`` holds the matching ground-truth records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

STYLES = 7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents split into first sentence and rest, with a class number that
    some of them lack. One scan: a join here would shuffle every text."""
    return (
        table(spark, sf, "documents")
        .withColumn("grade", F.expr("case when n_chars % 7 > 1 then n_chars % 2 end"))
        .withColumn("style", F.expr(f"cast(substr(source, 4) as int) % {STYLES}"))
        .withColumn("dataset", F.concat_ws("/", "source", "lang"))
        .withColumn("head", F.expr("split_part(text, '. ', 1)"))
        .withColumn("tail", F.expr("substr(text, length(head) + 1)"))
    )


def _json(**fields: str) -> str:
    inner = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"to_json(named_struct({inner}), map('ignoreNullFields', 'false'))"


def _by_style(cases: list[str]) -> str:
    whens = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
    return f"case style {whens} end"


RECORD_STYLES = [
    {"sentence": "text", "label": "grade"},
    {"idx": "doc_id", "Review": "text", "target": "grade"},
    {"premise": "head", "hypothesis": "tail", "class": "grade"},
    {"question": "head", "answer": "tail"},
    {"sentence1": "head", "sentence2": "tail", "labels": "grade"},
    {"input": "head", "output": "tail", "n_chars": "n_chars"},
    {"body_md": "text", "lang": "lang"},  # and flag, where it is known
]


def records(spark: SparkSession, sf: str) -> DataFrame:
    """``(dataset, row_id, row)``."""
    cases = [_json(**s) for s in RECORD_STYLES]
    cases[6] = "to_json(named_struct('body_md', text, 'lang', lang, 'flag', grade))"
    return documents(spark, sf).select(
        "dataset", F.col("doc_id").alias("row_id"), F.expr(_by_style(cases)).alias("row")
    )


def late_records(spark: SparkSession, sf: str) -> DataFrame:
    """``records`` in which a null label is left out, so that some datasets show
    their label column only after the first row."""
    rows = records(spark, sf)
    return rows.withColumn("row", F.regexp_replace(
        "row", r',"(label|target|class|labels)":null\}$', "}"))


def shifting_records(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a column of changing type, one that is often null and one that is late."""
    row = _json(text="text", n="n_chars", grade="grade", ok="n_chars % 2 = 0",
                ids="array(doc_id, null)", meta="named_struct('id', doc_id)")
    number, late = "concat('\"n\":', n_chars)", "concat(',\"late\":\"', lang, '\"}')"
    shifted = (f"case when doc_id % 5 = 2 then replace({row}, {number}, '\"n\":\"many\"') "
               f"else {row} end")
    whole = (f"case when doc_id % 4 = 3 then concat(substr(r, 1, length(r) - 1), {late}) "
             "else r end")
    return documents(spark, sf).withColumn("r", F.expr(shifted)).select(
        "dataset", F.col("doc_id").alias("row_id"), F.expr(whole).alias("row"))


GOOD = "case grade when 1 then 'good' when 0 then 'bad' end"


def reference(spark: SparkSession, sf: str) -> DataFrame:
    """``(dataset, row_id, task_data)``."""
    single = _json(text="text", label=GOOD, text_type="'document'",
                   metadata="named_struct('id', doc_id)")
    pair = _json(text_a="head", text_b="tail", label=GOOD, classes="array('bad', 'good')",
                 type_of_relation="'follows'")
    qa = _json(question="head", answer="tail", metadata="named_struct('id', doc_id)")
    gen = _json(input="head", output="tail", data_classification_policy="array('public')")
    cases = [single, single, pair, qa, pair, gen, single]
    return documents(spark, sf).select(
        "dataset", F.col("doc_id").alias("row_id"), F.expr(_by_style(cases)).alias("task_data")
    )


def malformed_reference(spark: SparkSession, sf: str) -> DataFrame:
    """``reference`` in which some records of some sources cannot be read."""
    broken = """case when cast(substr(source, 4) as int) % 3 <> 0 then task_data
      else case doc_id % 11 when 1 then concat(task_data, ' x')
        when 2 then concat(task_data, '{"text": "other"}')
        when 3 then replace(task_data, '"', '\\'')
        when 4 then substr(task_data, 1, length(task_data) - 1) else task_data end end"""
    listed = reference(spark, sf).withColumn("source", F.split_part("dataset", F.lit("/"), F.lit(1)))
    return listed.withColumn("doc_id", F.col("row_id")).select(
        "dataset", "row_id", F.expr(broken).alias("task_data"))


SPECS = [
    ("Classification", {"sentence1": "sentence", "labels": "label"}),
    ("Classification", {"sentence1": "Review", "labels": "target", "splits": ["train"]}),
    ("Classification", {"sentence1": "premise", "sentence2": "hypothesis", "labels": "class"}),
    ("MultipleChoice",
     {"choice0": "answer", "inputs": "input", "prompt": "question", "choice1": "missing"}),
    ("Classification", {"labels": "labels", "sentence1": "sentence1", "sentence2": "sentence2"}),
    ("SequenceToSequence", {"inputs": "input", "output": "output", "labels": 0}),
    ("TokenClassification", {"tokens": "tokens", "labels": "flag"}),
]


def specs(spark: SparkSession, sf: str) -> DataFrame:
    """A task table with one entry per dataset found in the documents:
    ``(id, dataset_name, config_name, task_type, mapping)``."""
    import json

    whens = [f"'{json.dumps(s)}'" for _, s in SPECS]
    kinds = [f"'{t}'" for t, _ in SPECS]
    return (
        table(spark, sf, "documents")
        .select("source", "lang")
        .distinct()
        .withColumn("style", F.expr(f"cast(substr(source, 4) as int) % {STYLES}"))
        .select(
            F.concat_ws("/", "source", "lang").alias("id"),
            F.col("source").alias("dataset_name"),
            F.col("lang").alias("config_name"),
            F.expr(_by_style(kinds)).alias("task_type"),
            F.expr(_by_style(whens)).alias("mapping"),
        )
    )


def doc_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as one typed table."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"), "lang")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("target"))
    return docs.join(labels, "doc_id")


def doc_task_data(spark: SparkSession, sf: str) -> DataFrame:
    named = F.struct(
        F.col("body").alias("text"),
        F.expr("case target when 1 then 'good' else 'bad' end").alias("label"),
        F.lit("document").alias("text_type"),
        F.struct(F.col("doc_id").alias("id")).alias("metadata"),
    )
    return doc_quality(spark, sf).select("doc_id", F.to_json(named).alias("task_data"))


def chat_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn right after them."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    replied = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(replied, ["conv_id", "turn"])


REPLY_KINDS = 14
PROSE = "translate(text, '{}`\"<>\\\\', '       ')"
REPLY_OBJECT = (
    "concat('{\"task\": \"classification\", \"text\": \"', source, '\", \"label\": \"', lang, "
    "'\", \"size\": ', cast(n_chars as string), '}')"
)


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """One model reply per document, in every form that parsing must handle:
    ``(dataset, method, doc_id, kind, raw, error)``. The prose in them is the
    whole text of the document."""
    fence, tick = "'```json\\n'", "'\\n```'"
    kinds = [
        "obj",
        f"concat(prose, '\\n', {fence}, obj, {tick}, '\\nDone.')",
        "concat('<think>', prose, '</think>\\n', obj)",
        "concat('<think>', prose, obj, '</think> no more')",
        "concat('<think>', prose, ' ', obj)",
        "concat('{\"task\": \"nli\", \"text\"_a\": \"', source, '\", \"label\": \"', lang, '\"}')",
        "concat('{\"task\": \"a}b{\", \"text\": \"', source, '\"}')",
        "prose",
        "concat(prose, '{}')",
        "concat(prose, '{x} ', obj)",
        f"concat('```\\n', obj, {tick}, '\\n', prose)",
        "concat('{\"task\": \"qa\", \"classes\": [\"bad\", \"good\"], \"label\": \"', lang, "
        "'\", \"size\": {\"k\": {\"z\": 1}}} ', prose)",
        "concat('<think>try {x} first</think>', obj)",
        "cast(null as string)",
    ]
    whens = " ".join(f"when {i} then {k}" for i, k in enumerate(kinds))
    return (
        table(spark, sf, "documents")
        .withColumn("prose", F.expr(PROSE))
        .withColumn("obj", F.expr(REPLY_OBJECT))
        .withColumn("kind", F.expr(f"cast(doc_id % {REPLY_KINDS} as int)"))
        .select(
            F.concat(F.lit("doc"), "doc_id").alias("dataset"),
            F.lit("local_llm").alias("method"),
            "doc_id",
            "kind",
            F.expr(f"case kind {whens} end").alias("raw"),
            F.expr("case when kind = 13 then 'timeout' end").alias("error"),
        )
    )


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """Card files of two catalogs, one card per part:
    ``(catalog_pos, path, body)``. Some are in both, some are not usable."""
    tasks = [
        "tasks.classification.binary", "tasks.classification.multi_class.relation",
        "tasks.qa.open", "tasks.summarization.abstractive", "tasks.regression",
    ]
    task = " ".join(f"when {i} then '{t}'" for i, t in enumerate(tasks))
    body = F.expr(f"""
        case p_partkey % 11
          when 7 then '{{"__type__": "task_card", '
          when 8 then concat('{{"__type__": "other", "task": "', p_brand, '"}}')
          when 9 then '{{"__type__": "task_card", "loader": {{"__type__": "load_hf", "path": "x"}}, "task": {{"a": "nli"}}}}'
          when 10 then '{{"__type__": "task_card", "loader": {{"__type__": "load_hf", "path": "x"}}, "task": "qa"}} end'
          else concat('{{"__type__": "task_card", "loader": {{"__type__": "load_hf", "path": "', p_name,
                      '", "name": ', case when p_size > 25 then concat('"', p_brand, '"') else 'null' end,
                      '}}, "task": "', case p_partkey % 5 {task} end, '"}}')
        end""")
    part = table(spark, sf, "part")
    path = F.concat(F.lower("p_type"), F.lit("/"), "p_partkey",
                    F.lit(".json"))
    first = part.select(F.lit(0).alias("catalog_pos"), path.alias("path"), body.alias("body"))
    second = part.select(
        F.lit(1).alias("catalog_pos"),
        path.alias("path"),
        F.concat(
            F.lit('{"__type__": "task_card", "loader": {"__type__": "load_hf", "path": "copy"}, '
                  '"task": "tasks.generation"}')
        ).alias("body"),
    )
    return first.unionByName(second)


def part_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """A task table with one entry per part; a config may be NaN."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("dataset_name"),
        F.expr("case when p_size % 5 = 0 then double('NaN') else cast(p_size as double) end")
        .alias("config_name"),
        F.expr("case p_type when 'ECONOMY' then 'Classification' when 'SMALL' then 'MultipleChoice'"
               " when 'MEDIUM' then 'TokenClassification' else 'SequenceToSequence' end")
        .alias("task_type"),
        F.concat(F.lit('{"sentence1": "'), "p_brand", F.lit('"}')).alias("mapping"),
    )


def lineitem_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Ground-truth records of every line item, under other names."""
    named = F.struct(
        F.col("l_orderkey").alias("order"),
        F.col("l_quantity").alias("amount"),
        F.col("l_discount").alias("rebate"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").alias("day"),
        F.lit("row").alias("unit_type"),
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_json(named).alias("task_data")
    )
