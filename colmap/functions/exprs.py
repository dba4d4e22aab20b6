"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmap.functions import vocab
from colmap.session import written

# One mapping entry: a canonical field with what a method proposed for it.
# ``value`` is set for strings only; ``value_json`` holds any value as JSON.
ENTRY = "struct<pos:int,field:string,value:string,is_string:boolean,value_json:string>"
ENTRIES = f"array<{ENTRY}>"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def exact_order(order: Iterable[str | Column]) -> list[str | Column]:
    """Names to order by, quoted, so that a dot in one is not taken for a path."""
    return [F.col(quoted(c)) if isinstance(c, str) else c for c in order]


def exact_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """A table whose columns can be told apart whatever their case, and the name
    each original column has in it."""
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df, {c: c for c in df.columns}
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Union by name as a balanced tree: the plan of n tables stays log n deep."""
    parts = list(parts)
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]


def text_array(words: Iterable[str]) -> Column:
    words = list(words)
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def strict_json(text: Column, schema: T.DataType) -> Column:
    """JSON text read by ``schema`` as the one element of an array; no element, or a
    null one, if the text is anything else.

    The text is parsed as the only element of a list, since the parser would ignore
    anything after a bare object; and inside a lambda, which names the result: an
    expression that is used twice would be parsed twice.
    """
    listed = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(schema),
        {"allowSingleQuotes": "false"})
    return F.transform(F.array(listed), lambda found: F.when(F.size(found) == 1, F.get(found, 0)))


def as_map(text: Column) -> Column:
    """A JSON object as a map; null if the text is anything else."""
    return F.get(strict_json(text, T.MapType(T.StringType(), T.StringType())), 0)


def no_entries() -> Column:
    return F.array().cast(ENTRIES)


def json_string(value: Column) -> Column:
    """A string as a JSON string literal, UTF-8 kept as it is."""
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def entries_of(pairs: list[tuple[str, Column]]) -> Column:
    """Entries from (field, column name or null) pairs; null ones are left out."""
    if not pairs:
        return no_entries()
    return listed_entries(F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in pairs]),
        lambda e: e["value"].isNotNull(),
    ))


def listed_entries(found: Column) -> Column:
    """Entries from an array of (field, value)."""
    return F.transform(
        found,
        lambda e, i: F.struct(
            i.cast("int").alias("pos"),
            e["field"].alias("field"),
            e["value"].alias("value"),
            F.lit(True).alias("is_string"),
            json_string(e["value"]).alias("value_json"),
        ),
    ).cast(ENTRIES)


def entries_from_json(text: Column) -> Column:
    """Entries of a well-formed JSON object, in the order of its keys."""
    items = F.map_entries(F.from_json(text, "map<string,variant>"))

    def one(e: Column, i: Column) -> Column:
        is_string = F.coalesce(F.schema_of_variant(e["value"]) == "STRING", F.lit(False))
        return F.struct(
            i.cast("int").alias("pos"),
            e["key"].alias("field"),
            F.when(is_string, F.try_variant_get(e["value"], "$", "string")).alias("value"),
            is_string.alias("is_string"),
            F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value_json"),
        )

    return F.coalesce(F.transform(items, one).cast(ENTRIES), no_entries())


def annotation_key(key: str) -> bool:
    """``is_annotation`` for a key the driver holds."""
    return key in vocab.ANNOTATION_KEYS or key.endswith(vocab.ANNOTATION_SUFFIX)


def is_annotation(field: Column, with_task: bool = False) -> Column:
    """Keys that describe the data instead of naming a column."""
    names = vocab.ANNOTATION_KEYS + (["task"] if with_task else [])
    return field.isin(*names) | field.endswith(vocab.ANNOTATION_SUFFIX)


def is_data_key(field: Column) -> Column:
    """Keys of a ground-truth record that hold data."""
    return ~field.isin(*vocab.METADATA_KEYS) & ~is_annotation(field)


def task_of(fields: Column) -> Column:
    """Task that a set of mapped fields implies."""
    families = list(vocab.TASK_KEYS.items())
    result = F.lit(vocab.DEFAULT_TASK)
    for task, keys in reversed(families):
        result = F.when(F.arrays_overlap(fields, text_array(keys)), F.lit(task)).otherwise(result)
    return result


def catalog_task(task: Column) -> Column:
    """Catalog name of a task; unknown tasks get the default name."""
    known = F.create_map(*[F.lit(x) for kv in vocab.TASK_CATALOG.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(task)), F.lit(vocab.DEFAULT_CATALOG_TASK))


def task_match(truth: Column, predicted: Column) -> Column:
    """Do two task names belong to one family?"""
    gt, pred = F.lower(truth), F.lower(predicted)
    same = gt == pred
    for group in vocab.TASK_GROUPS:
        words = "|".join(group)
        same = same | (gt.rlike(words) & pred.rlike(words))
    return same


def card_family(task: Column, requested: Iterable[str] | None = None) -> Column:
    """First requested family whose words occur in a card's task name, or null.

    A task given as a JSON object or list belongs to no family.
    """
    wanted = list(requested or vocab.CARD_FAMILIES)
    result = F.lit(None).cast("string")
    for family in reversed([w for w in wanted if w in vocab.CARD_FAMILIES]):
        some, none = vocab.CARD_FAMILIES[family]
        hit = F.lit(False)
        for word in some:
            hit = hit | task.contains(word)
        for word in none:
            hit = hit & ~task.contains(word)
        result = F.when(hit, F.lit(family)).otherwise(result)
    nested = task.startswith("{") | task.startswith("[")
    return F.when(task.isNotNull() & ~nested, result)


def card_id(path: Column) -> Column:
    """Card name: path below the ``cards`` folder, extension off, ``/`` -> ``.``"""
    return F.replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("/"), F.lit("."))


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity of two arrays; two empty sets are equal (1.0)."""
    total = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def half_even(value: Column, digits: int = 3) -> Column:
    return F.bround(value, digits)


def rename_plan(entries: Column) -> Column:
    """Rename steps of a mapping as text."""
    steps = F.transform(
        F.filter(
            entries,
            lambda e: (e["field"] != "task") & e["is_string"] & (e["value"] != e["field"]),
        ),
        lambda e: F.format_string(vocab.RENAME_STEP, e["value"], e["field"]),
    )
    return (
        F.when(F.size(entries) <= 0, F.lit(vocab.PLAN_FAILED))
        .when(F.size(steps) == 0, F.lit(vocab.PLAN_EMPTY))
        .otherwise(F.array_join(steps, ", "))
    )


def mapping_json(entries: Column) -> Column:
    """A mapping as one JSON object text."""
    parts = F.transform(
        entries, lambda e: F.concat(json_string(e["field"]), F.lit(": "), e["value_json"])
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def predicted_columns(entries: Column) -> Column:
    """Distinct column names a mapping points to, names that do not exist included."""
    kept = F.filter(
        entries, lambda e: e["is_string"] & ~is_annotation(e["field"], with_task=True)
    )
    return F.array_distinct(F.transform(kept, lambda e: e["value"]))


def value_key(value: Column) -> Column:
    """A value as a key of at most 65 characters: text up to 64 as it is, longer
    text as its 256-bit digest with a mark, which makes 65. Documents are then
    compared without being shuffled.
    """
    return F.when(F.length(value) <= 64, value).otherwise(
        F.concat(F.lit("#"), F.sha2(value, 256))
    )


def text_form(name: str, data_type: T.DataType) -> Column:
    """A column as the text it has after a round trip through JSON, which is how
    the values of ground-truth records arrive."""
    col = F.col(quoted(name))
    if isinstance(data_type, T.StringType):
        return col
    if isinstance(data_type, T.TimestampType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    if isinstance(data_type, T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    if isinstance(data_type, T.DecimalType):
        return col.cast("double").cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.base64(col)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.from_json(F.to_json(F.struct(col.alias("v"))), "v string")["v"]
    return col.cast("string")


def exact_form(name: str, data_type: T.DataType) -> Column:
    """A column as text that differs for any two of its values; times keep the
    digits below a millisecond that JSON drops."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.col(quoted(name)).cast("string")
    return text_form(name, data_type)


def column_key(name: str, data_type: T.DataType, form=text_form) -> Column:
    """``value_key`` of a column's text; number and date texts are short anyway."""
    text = form(name, data_type)
    short = (T.NumericType, T.BooleanType, T.DatetimeType)
    return text if isinstance(data_type, short) else value_key(text)


#: places up to which Spark prunes groups while it ranks them (its default)
GROUP_LIMIT = 1000


def _first_of_ranges(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """``first_rows`` without a task that gets a whole group."""
    placed = written(
        df.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.where(F.col("_before") < n).select(
        F.col(by).alias("_by"), F.col("_part").alias("_in"), "_before")
    near = Window.partitionBy(by, "_part").orderBy(*order)
    return (
        placed.withColumn("rn", F.row_number().over(near))
        .join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_in")))
        .withColumn("rn", (F.col("rn") + F.col("_before")).cast("int"))
        .where(F.col("rn") <= n).drop("_part", "_by", "_in", "_before")
    )


def first_rows(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group, with their place as ``rn``.

    Ranks twice: first within (group, salt), where the salt is the number of the
    input partition, so no task ever gets more than its share of one large
    group; then over the at most ``64 * n`` rows left of each group. Spark keeps
    only the first rows while it ranks up to ``GROUP_LIMIT``; for more, rows are
    placed by ranges and numbered with the counts of the ranges in front.
    """
    if n > GROUP_LIMIT:
        return _first_of_ranges(df, by, order, n)
    salted = df.withColumn("_salt", F.spark_partition_id() % 64)
    near = Window.partitionBy(by, "_salt").orderBy(*order)
    far = Window.partitionBy(by).orderBy(*order)
    return (
        salted.withColumn("rn", F.row_number().over(near))
        .where(F.col("rn") <= n)
        .drop("_salt")
        .withColumn("rn", F.row_number().over(far))
        .where(F.col("rn") <= n)
    )
