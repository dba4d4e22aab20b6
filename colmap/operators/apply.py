"""Applying a mapping to a whole table, batch or stream."""

from __future__ import annotations

import json
import sys
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmap.functions import vocab
from colmap.functions.exprs import (
    annotation_key,
    exact_names,
    is_annotation,
    quoted,
    rename_plan,
    strict_json,
)

# Tasks carry these functions with them, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Resolved:
    """What a mapping means for one table: columns to read and constants to add."""

    renames: dict[str, str] = field(default_factory=dict)  # raw column -> field
    constants: dict[str, str] = field(default_factory=dict)
    classes: list | str | None = None


def resolve(mapping: Mapping, columns: list[str]) -> Resolved:
    """Split a mapping by key first, then by whether its value is a column.

    Of two fields on one column the later one names it, in the earlier one's
    place.
    """
    out = Resolved(classes=mapping.get("classes") or None)
    present = set(columns)
    for key, value in mapping.items():
        if key in ("task", "classes") or not isinstance(value, str):
            continue
        if value in present and not annotation_key(key):
            out.renames[value] = key
        else:
            out.constants[key] = value
    return out


def resolve_entries(proposals: DataFrame, column_sets: DataFrame) -> DataFrame:
    """The same decision for many mappings at once, as rows
    ``(dataset, method, pos, field, value, kind)``; kind is column, constant or
    ignored."""
    is_column = F.coalesce(F.array_contains("cols", F.col("value")), F.lit(False))
    kind = (
        F.when(~F.col("is_string") | F.col("field").isin("task", "classes"), F.lit("ignored"))
        .when(is_column & ~is_annotation(F.col("field")), F.lit("column"))
        .otherwise(F.lit("constant"))
    )
    return (
        proposals.join(column_sets, "dataset", "left")
        .select("dataset", "method", "cols", F.inline("entries"))
        .select("dataset", "method", "pos", "field", "value", kind.alias("kind"))
    )


CLASSES = "struct<text string, names array<string>>"


def class_texts(found: pa.Array) -> pa.Array:
    """Classes given as JSON: the text that stands for all of them, and each one's.

    Both are as Python shows them, which no JSON text is; empty classes have neither.
    """
    texts, names = [], []
    for given in found.to_pylist():
        classes = None if given is None else json.loads(given)
        texts.append(str(classes) if classes else None)
        listed = classes and isinstance(classes, (list, str))
        names.append([str(c) for c in classes] if listed else None)
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array(names, pa.list_(pa.string()))], ["text", "names"])


def mapping_plans(proposals: DataFrame, column_sets: DataFrame) -> DataFrame:
    """What each mapping does: ``(dataset, method, plan, classes, names)``.

    ``plan`` is an array of (field, col, text), in the order of ``apply_mapping``: a
    column to read, or a constant. Of two fields on one column the later one names
    it, in the earlier one's place; of two lines for one field the later one counts.
    ``classes`` is the text of the class list and ``names`` the classes, null without any.
    """
    lines = resolve_entries(proposals, column_sets).where("kind <> 'ignored'")
    columns = lines.where("kind = 'column'").groupBy("dataset", "method", "value").agg(
        F.min("pos").alias("pos"), F.max_by("field", "pos").alias("field")
    ).select("dataset", "method", F.lit(0).alias("rank"), "pos", "field",
             F.col("value").alias("col"), F.lit(None).cast("string").alias("text"))
    constants = lines.where("kind = 'constant'").select(
        "dataset", "method", F.lit(1).alias("rank"), "pos", "field",
        F.lit(None).cast("string").alias("col"), F.col("value").alias("text"))
    every = columns.unionByName(constants).groupBy("dataset", "method", "field").agg(
        F.min(F.struct("rank", "pos")).alias("place"),
        F.max_by(F.struct("col", "text"), F.struct("rank", "pos")).alias("source"))
    plans = every.groupBy("dataset", "method").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "field", "source"))),
        lambda p: F.struct(p["field"].alias("field"), p["source"]["col"].alias("col"),
                           p["source"]["text"].alias("text"))).alias("plan"))
    classes = proposals.select(
        "dataset", "method", F.filter("entries", lambda e: e["field"] == "classes").alias("c")
    ).select("dataset", "method", F.arrow_udf(class_texts, CLASSES)(
        F.get("c", 0)["value_json"]).alias("c")).select(
        "dataset", "method", F.col("c.text").alias("classes"), F.col("c.names").alias("names"))
    return classes.join(plans, ["dataset", "method"], "left").withColumn(
        "plan", F.coalesce("plan", F.array().cast(
            "array<struct<field:string,col:string,text:string>>")))


def apply_rows(rows: DataFrame, plans: DataFrame, typed: bool = False) -> DataFrame:
    """Every schemaless row under every mapping of its dataset:
    ``(dataset, method, row_id, fields, error)``.

    ``fields`` is a map from field to text, or to a typed value (a variant) if
    ``typed``. One join with a table that has a line per mapping; integer labels become
    class names, nulls stay null. A row that is missing or is not one JSON object has no
    fields but an ``error``.
    """
    schema = T.MapType(T.StringType(), T.VariantType())

    def text(value):
        return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))

    def variant(value):
        return value.cast("variant") if typed else value

    def shown(p):
        value = F.try_element_at(F.col("_values"), p["col"])
        kind = F.schema_of_variant(value)
        plain = F.when(kind != "VOID", value if typed else text(value))
        index = F.try_variant_get(value, "$", "int")
        named = F.when(kind.isin("BIGINT", "BOOLEAN") & (index >= 0), F.get("names", index))
        decoded = F.when(
            p["field"] == "label", F.coalesce(variant(named), plain)).otherwise(plain)
        return F.struct(p["field"].alias("a"), F.when(
            p["col"].isNull(), variant(p["text"])).otherwise(decoded).alias("b"))

    kind = "variant" if typed else "string"
    classes = F.when(F.col("classes").isNotNull(), F.array(F.struct(
        F.lit("classes").alias("a"), variant(F.col("classes")).alias("b")))).otherwise(
        F.array().cast(f"array<struct<a:string,b:{kind}>>"))
    known = F.col("_values").isNotNull()
    return (
        rows.join(plans, "dataset")
        .select("dataset", "method", "row_id", "plan", "classes", "names",
                F.get(strict_json(F.col("row"), schema), 0).alias("_values"))
        .select("dataset", "method", "row_id",
                F.when(known, F.map_from_entries(
                    F.concat(F.transform("plan", shown), classes))).alias("fields"),
                F.when(~known, F.lit(vocab.UNREADABLE_ROW)).alias("error"))
    )


def plan_types(plans: DataFrame, types: DataFrame) -> DataFrame:
    """The type of every field that mappings make: ``(dataset, method, pos, field, dtype)``.

    ``types`` has the types of the raw columns (``column_types``). Constants and labels
    with class names are text.
    """
    lines = plans.select(
        "dataset", "method", F.col("names").isNotNull().alias("named"), F.posexplode(F.concat(
            "plan", F.when(F.col("classes").isNotNull(), F.array(F.struct(
                F.lit("classes").alias("field"), F.lit(None).cast("string").alias("col"),
                F.col("classes").alias("text")))).otherwise(
                F.array().cast("array<struct<field:string,col:string,text:string>>")))
        ).alias("pos", "p"))
    text = F.col("p.col").isNull() | (F.col("named") & (F.col("p.field") == "label"))
    return lines.select(
        "dataset", "method", "pos", F.col("p.field").alias("field"), F.col("p.col").alias("col"),
        text.alias("is_text"),
    ).join(types.select("dataset", "col", "dtype"), ["dataset", "col"], "left").select(
        "dataset", "method", "pos", "field",
        F.when(F.col("is_text"), F.lit("STRING")).otherwise(
            F.coalesce("dtype", F.lit("VOID"))).alias("dtype"))


def decode_label(value: Column, data_type: T.DataType, classes: list | str) -> Column:
    """Class name of an integer label; numbers out of range stay as text."""
    if not isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return value
    names = F.array(*[F.lit(str(c)) for c in classes])
    index = value.cast("long")
    known = (index >= 0) & (index < len(classes))
    place = F.when(known, index + 1).otherwise(F.lit(1)).cast("int")
    return F.when(known, F.element_at(names, place)).otherwise(value.cast("string"))


def apply_mapping(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Standardized form of ``df``: one projection over the whole table.

    Only referenced columns are read. Integer labels become class names, other
    string values become constant columns, and ``classes`` is kept as text.
    """
    source, name_in = exact_names(df)
    types = {f.name: f.dataType for f in df.schema.fields}

    plan = resolve(mapping, df.columns)
    out = {}
    for raw, name in plan.renames.items():
        value = F.col(quoted(name_in[raw]))
        if name == "label" and plan.classes:
            value = decode_label(value, types[raw], plan.classes)
        out[name] = value
    for name, text in plan.constants.items():
        out[name] = F.lit(text)
    if plan.classes:
        out["classes"] = F.lit(str(plan.classes))
    return source.select(*[value.alias(name) for name, value in out.items()])


def rename_text(proposals: DataFrame) -> DataFrame:
    """Rename plan of every mapping as text."""
    return proposals.select("dataset", "method", rename_plan(F.col("entries")).alias("code"))
