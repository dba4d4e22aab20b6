"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when at least ``threshold`` of the item's distinct
five-word shingles occur in it. Containment, not similarity, is searched for, so
the length of the document does not matter.

Items are partitioned by their number of shingles ``n``. At most
``n - ceil(threshold * n)`` shingles may be missing, so of the ``k`` least hashes
of an item (its bottom-k MinHash sketch), with ``k`` one more than that, at least
one is in every document that contains the item. A document is a candidate for an
item when one of its shingle hashes is in the item's sketch; nothing is missed.
Candidates are verified by exact shingles as text.

Words are runs without ASCII white space, in lower case. A text of fewer than five
words has one shingle, the whole of it, so a short item is found in documents that
consist of it. Documents are never cut.

Cases: null and blank texts have no shingles and match nothing; null ids are
ordinary ids; items with equal words are one item under their least id; rows that
repeat an id give one row with their largest containment; ties do not arise; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmap.llm.common import free_name, quoted, small, words
from colmap.session import written

SHINGLE = 5
THRESHOLD = 0.8


def shingles(w: Column) -> Column:
    """The shingles of an array of words, as text, repeats included."""
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(
        F.size(w) < SHINGLE, F.array(F.array_join(w, " "))
    ).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)),
        lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))


def hashes(w: Column) -> Column:
    """One hash for each shingle, made from its words without joining them."""
    return F.when(F.size(w) == 0, F.array().cast("array<long>")).when(
        F.size(w) < SHINGLE, F.array(F.xxhash64(F.array_join(w, " ")))
    ).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item, h): the bottom-k hashes of each item; k follows from its size."""
    n = F.size("hs")
    allowed = n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int")
    return (
        items.select("item", F.array_sort(F.array_distinct(hashes(F.col("w")))).alias("hs"))
        .select("item", F.explode(F.slice("hs", F.lit(1), allowed + 1)).alias("h"))
    )


def contained(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for each item found."""
    split = docs.select(
        quoted(id_col).alias("doc_id"), words(F.lower(quoted(text_col))).alias("w"))
    items = written(
        benchmark.select("item_id", words(F.lower("text")).alias("w")).where(F.size("w") > 0)
        .groupBy("w").agg(F.min("item_id").alias("item_id"))
        .withColumn("item", F.monotonically_increasing_id()), "items")
    sketch = written(sketches(items, threshold), "sketches")
    # exploded hashes meet the sketches before anything is shuffled
    candidates = written(
        split.select("doc_id", F.explode(hashes(F.col("w"))).alias("h"))
        .join(small(sketch, sketch.count()), "h").select("doc_id", "item").distinct(),
        "candidates")
    n, n_items = candidates.count(), items.count()
    wanted = items.select("item", "item_id", F.array_distinct(shingles(F.col("w"))).alias("item_shingles"))
    listed = split.join(small(
        candidates.groupBy(F.col("doc_id").alias("found_id")).agg(
            F.collect_set("item").alias("items")), n), F.col("doc_id").eqNullSafe(
                F.col("found_id")))
    shared = F.size(F.array_intersect("item_shingles", "doc_shingles"))
    size = F.size("item_shingles")
    return (
        listed.select("doc_id", F.array_distinct(shingles(F.col("w"))).alias("doc_shingles"),
                      F.explode("items").alias("item"))
        .join(small(wanted, n_items), "item")
        .select("doc_id", "item", "item_id", size.cast("long").alias("n_shingles"),
                shared.cast("long").alias("n_shared"))
        .where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9))
        .groupBy("doc_id", "item", "item_id", "n_shingles")
        .agg(F.max("n_shared").alias("n_shared")).drop("item")
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    )


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no item is found.

    What is found in a row follows from its text, so rows are known by its hash; null
    and repeated ids do no harm.
    """
    key = free_name(docs, "text_hash")
    marked = docs.withColumn(key, F.xxhash64(quoted(text_col)))
    found = written(contained(marked, benchmark, threshold, key, text_col).select(
        F.col("doc_id").alias(key)).distinct(), "contaminated")
    return marked.join(small(found, found.count()), key, "left_anti").select(
        *[quoted(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
                     lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')),
                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0 GROUP BY w),
ds AS (
  SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s
  FROM d),
si AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s
  FROM i),
n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id),
hit AS (SELECT rid, doc_id, item_id, count(*) AS n_shared
        FROM ds JOIN si USING (s) GROUP BY rid, doc_id, item_id)
SELECT doc_id, item_id, n_shingles, max(n_shared) AS n_shared,
       max(n_shared) / n_shingles::DOUBLE AS containment
FROM hit JOIN n USING (item_id)
WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9)
GROUP BY doc_id, item_id, n_shingles
"""
