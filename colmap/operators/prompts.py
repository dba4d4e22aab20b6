"""Model prompts, one per dataset, from its columns and first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmap.functions import vocab
from colmap.functions.exprs import first_rows, json_string

_SINGLE = '{"task": "<task type>", "text": "<column>", "label": "<column>"}'
_PAIRED = '{"task": "<task type>", "text_a": "<column>", "text_b": "<column>", "label": "<column>"}'

SYSTEM = {
    "api": "You are a data scientist who standardizes NLP datasets. "
    "From a few raw rows you work out which column plays which standard role.",
    "local": "You are a data scientist who standardizes NLP datasets. "
    "From a few raw rows you work out the task and which column plays which standard role. "
    "Reply with one valid JSON object and nothing else.",
}

_FORMATS = {
    "api": f"With one text column reply:\n{_SINGLE}\n\n"
    f"With two text columns, as in inference, similarity or question answering, reply:\n{_PAIRED}",
    "local": "Use exactly one of these two forms.\n\n"
    f"One text column:\n{_SINGLE}\n\nTwo text columns:\n{_PAIRED}",
}

_RULES = (
    "Rules:\n"
    "- Values are raw column names only, never class names or other text.\n"
    "- \"label\" names the column that holds the target.\n"
    "- Do not mix the forms: with \"text\" there is no \"text_a\" or \"text_b\"."
)


def samples(rows: DataFrame, n: int = vocab.PROMPT_ROWS, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows of each dataset as one array of JSON texts."""
    kept = first_rows(rows.select("dataset", order, "row"), "dataset", [order], n)
    ordered = F.array_sort(F.collect_list(F.struct("rn", "row")))
    return kept.groupBy("dataset").agg(F.transform(ordered, lambda r: r["row"]).alias("sample"))


def response_format(model_id):
    """JSON mode for the model families that support it, else null."""
    wanted = F.lit(False)
    for prefix in vocab.JSON_MODE_PREFIXES:
        wanted = wanted | model_id.startswith(prefix)
    return F.when(wanted, F.lit(vocab.JSON_MODE))


def build_prompts(
    columns: DataFrame,
    sampled: DataFrame,
    backend: str = "api",
    model_id: str = "",
    instruction: str | None = None,
    method: str | None = None,
) -> DataFrame:
    """``(dataset, method, backend, model_id, system, user, response_format,
    temperature, max_new_tokens)``.

    A prompt holds a whole schema and a few rows by definition, so the arrays
    collected per dataset are as wide as one schema and ``n`` rows long.
    """
    schema = columns.where(F.col("col").isNotNull()).groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct("pos", "col", "dtype"))).alias("schema")
    )
    names = F.array_join(F.transform("schema", lambda c: json_string(c["col"])), ", ")
    types = F.array_join(
        F.transform(
            "schema",
            lambda c: F.concat(json_string(c["col"]), F.lit(": "), json_string(c["dtype"])),
        ),
        ", ",
    )
    lines = F.coalesce(F.array_join("sample", "\n"), F.lit(""))
    extra = f"\n- Note: {instruction}" if instruction else ""
    user = F.concat(
        F.lit("Work out the NLP task of this dataset and map its columns to standard fields.\n\n"
              "Dataset:\n- Columns: ["),
        names,
        F.lit("]\n- Types: {"),
        types,
        F.lit("}\n- Rows:\n"),
        lines,
        F.lit(f"{extra}\n\n"
              "Task types are for example classification, nli, regression, translation, "
              "summarization.\n"
              "Reply with a single valid JSON object, no explanation, no markdown.\n\n"
              f"{_FORMATS[backend]}\n\n{_RULES}"),
    )
    return schema.join(sampled, "dataset", "left").select(
        "dataset",
        F.lit(method or f"{backend}_llm").alias("method"),
        F.lit(backend).alias("backend"),
        F.lit(model_id).alias("model_id"),
        F.lit(SYSTEM[backend]).alias("system"),
        user.alias("user"),
        response_format(F.lit(model_id)).alias("response_format"),
        F.lit(vocab.TEMPERATURE).alias("temperature"),
        F.lit(vocab.MAX_NEW_TOKENS if backend == "local" else None).cast("int")
        .alias("max_new_tokens"),
    )
