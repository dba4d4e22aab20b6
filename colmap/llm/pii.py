r"""Personal data by patterns, and by contexts learned from what the patterns find.

Base entities are the leftmost non-overlapping matches of one pattern per kind;
matches that fail the kind's check are dropped. They seed a bootstrap:

1. The two words left of a seed are a lexical pattern for its kind. A pattern needs
   ``MIN_SEEDS`` distinct seeds.
2. Tokens with a digit or an at sign outside all seeds are candidate instances, and
   so is a run of number tokens with only blanks between them, unless each of them
   has the shape of a kind alone, as in a list. Patterns and instances form a graph,
   an edge for each context in which an instance stands.
3. A pattern's confidence is the confidence of the instances in it by the number of
   times its two words occur in the corpus, whatever follows, further entries of a
   list behind them counted too; an instance's is one
   less the product of its patterns' doubts. Seeds have confidence one. ``ROUNDS``
   rounds are made.
4. Candidates of confidence ``ACCEPT`` or more that look like their kind are added; of
   a run that is added, the tokens alone are not.

The two words are looked for in the whole text before the token, tokens with a digit or
an at sign left out, by one rule for seeds, candidates and totals: each entry of a list
has the words before the list. A token begins after white space, a colon or an equals
sign.

Dividing by all occurrences keeps patterns apart from words that merely happen to
stand before an entity now and then.

Match positions come from the pieces between matches: their lengths are summed up
per document and kind in a window, so a document with many matches costs no more
than sorting them. Patterns never go back over what they have read, so that long
runs of digits or letters take linear time.

Cases: null and empty texts have no spans; texts are read whole; positions are code
points; every input row gives a row, repeated ids included; null ids stay null;
equal spans of different kinds are all kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmap.llm.common import BROADCAST_ROWS, small
from colmap.session import written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # a match starts where a run of its characters starts, or where the last match ended
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![^\s:=])[^\s:=0-9@]*+[0-9@]\S*+"
#: number tokens that another may follow, and that may follow another, in one number
LEADING = r"^[+(]*+[0-9][0-9().-]*+(?<=[0-9)])$"
FOLLOWING = r"^\(?[0-9][0-9().-]*+[^\p{L}\p{N}]*+$"
#: what a text must contain for its kind to be looked for
HINT = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "token": "[0-9@]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

MIN_SEEDS = 3
ROUNDS = 3
ACCEPT = 0.8
#: contexts that are looked for by a set in the plan instead of a join
LITERALS = 10_000
#: shape that a candidate of a kind must have
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]+(?:[.:][0-9]+){3,}$",
    "card": r"^(?=(?:[^0-9]*[0-9]){8})[0-9-]+$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){6})[+(]?[0-9().-]+$",
}
#: the same for runs, which are joined by spaces
RUN_SHAPES = {
    "card": r"^(?=(?:[^0-9]*[0-9]){8})(?!(?:[^0-9]*[0-9]){20})[0-9-]+(?: [0-9-]+)+$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){6})(?!(?:[^0-9]*[0-9]){16})[+(]?[0-9().-]+(?: [0-9().-]+)+$",
}


def _found(text: Column, kind: str) -> Column:
    """The matches of a kind in order; texts without its hint are not searched."""
    found = F.regexp_extract_all(text, F.lit(_pattern(kind)), F.lit(0))
    return F.when(text.rlike(HINT[kind]), found).otherwise(F.array().cast("array<string>"))


def _pattern(kind: str) -> str:
    return TOKEN if kind == "token" else PATTERNS[kind]


def _matches(text: Column, kind: str, found: Column) -> Column:
    """(kind, i, value, gap, words, blank) of each match of ``found``, in order.

    ``gap`` is the length of the text between the match before and this one; for
    tokens, ``words`` are its last two words, the last one first, and ``blank`` says
    that it is spaces only.
    """
    pieces = F.when(F.size(found) > 0, F.split(text, _pattern(kind), -1)).otherwise(
        F.array().cast("array<string>"))

    def words(before):
        return F.slice(F.reverse(_plain_words(before)), 1, 2) if kind == "token" else F.array().cast(
            "array<string>")

    return F.transform(
        F.arrays_zip(found.alias("value"), F.slice(pieces, F.lit(1), F.size(found))
                     .alias("before")),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), z["value"].alias("value"),
            F.length(z["before"]).alias("gap"),
            words(z["before"]).alias("words"), z["before"].rlike(r"^[ \t]+$").alias("blank")))


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        (kind == "email")
        | ((kind == "ip") & value.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        | ((kind == "card") & n.between(13, 19) & F.call_function("luhn_check", digits))
        | ((kind == "phone") & n.between(9, 15))
    )


def _plain_words(text: Column) -> Column:
    """Words of letters, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All valid matches and tokens with their positions, and a row for texts without any.

    ``row`` numbers the input rows, ``base`` marks valid matches. For tokens, ``context``
    is a hash of the two words before (null if there are not two) and ``fresh`` marks
    those with a word since the last token.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = (*KINDS, "token")
    # rows get their numbers before the matches of a text become rows; the matches are a
    # column first, since they are used more than once
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        text.alias("text"), *[_found(text, k).alias(f"in_{k}") for k in kinds],
    ).select(
        "row", "doc_id",
        F.concat(*[_matches(F.col("text"), k, F.col(f"in_{k}")) for k in kinds]).alias("events"),
    ).select("row", "doc_id", F.explode_outer("events").alias("e")).select("row", "doc_id", "e.*")
    length = F.length("value")
    along = Window.partitionBy("row", "kind").orderBy("i")
    start = F.sum(F.col("gap") + length).over(along) - length
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    last, second = F.get("words", F.lit(0)), F.coalesce(F.get("words", F.lit(1)), F.col("earlier"))
    return written(
        rows.withColumn("start", start).withColumn("end", F.col("start") + length)
        .withColumn("earlier", F.last(last, ignorenulls=True).over(past))
        .withColumn("pair", F.when(
            last.isNotNull() & second.isNotNull(), F.xxhash64(second, last)))
        .withColumn("context", F.last("pair", ignorenulls=True).over(
            along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select(
            "row", "doc_id", "kind", "value", "start", "end", "context",
            last.isNotNull().alias("fresh"), "blank",
            F.coalesce(_valid(F.col("kind"), F.col("value")), F.lit(False)).alias("base"))
        .where("kind is null or kind = 'token' or base"),
        "pii-occurrences")


def _places(found: DataFrame) -> DataFrame:
    """Base entities and tokens, both with the context of the token they begin in.

    Of tokens, ``free`` ones touch no base entity, ``run`` numbers the runs of a text,
    ``single`` marks tokens that are a run alone, and ``entry`` the tokens that stand
    behind a context as a further entry of a list.
    """
    # a token comes before a base entity that begins with it
    order = Window.partitionBy("row").orderBy("start", "base")
    ahead = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    token, value = ~F.col("base"), F.col("value")
    free = token & F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(
        F.col("next") >= F.col("end"), F.lit(True))
    # what stands between two free tokens is no base entity
    joint = F.col("free") & F.col("blank") & value.rlike(FOLLOWING) & F.coalesce(
        F.lag(F.col("free") & value.rlike(LEADING)).over(order), F.lit(False))
    inside = F.coalesce(F.col("reached") > F.col("start"), F.lit(False))
    return written(
        found.where("kind is not null")
        .withColumn("reached", F.max(F.when(F.col("base"), F.col("end"))).over(ahead))
        .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
        .withColumn("context", F.last(F.when(token, F.struct("context")), ignorenulls=True)
                    .over(ahead)["context"])
        .withColumn("free", free).withColumn("joint", joint)
        .withColumn("run", F.sum(F.when(F.col("joint"), 0).otherwise(1)).over(ahead))
        .withColumn("single", ~F.col("joint") & ~F.coalesce(
            F.lead("joint").over(order), F.lit(False)))
        .withColumn("entry", token & ~F.col("fresh") & ~F.col("joint") & ~inside)
        .where("context is not null")
        .select("row", "kind", "value", "start", "end", "context", "base", "free", "run",
                "single", "entry"), "pii-places")


def _candidates(places: DataFrame) -> DataFrame:
    """Free tokens and runs without the punctuation around them, if a kind has their shape."""
    kept = F.regexp_replace("value", r"^[^\p{L}\p{N}+(]+", "")
    core = F.regexp_replace(kept, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    free = places.where("free")

    def trimmed(df, shapes):
        return df.select(
            "row", "run", "context", "whole", core.alias("core"),
            (F.col("start") + F.length("value") - F.length(kept)).alias("start"),
            (F.col("end") - F.length(kept) + F.length(core)).alias("end"),
        ).where(_any([F.col("core").rlike(rule) for rule in shapes.values()]))

    # in a list, each token is a number of its own
    alone = _any([core.rlike(rule) for rule in SHAPES.values()])
    runs = (
        free.where("not single").groupBy("row", "run", "context").agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.min(alone).alias("is_list"),
            F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
        .where("not is_list")
        .withColumn("value", F.array_join(F.col("parts")["value"], " "))
    )
    return trimmed(free.withColumn("whole", F.lit(False)), SHAPES).unionByName(
        trimmed(runs.withColumn("whole", F.lit(True)), RUN_SHAPES))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _corpus_counts(
    docs: DataFrame, text_col: str, places: DataFrame, contexts: DataFrame, n: int,
) -> DataFrame:
    """(context, total): how often each of ``n`` contexts occurs in all texts.

    Each further entry of a list is one more occurrence of the words before the list.
    Pairs of other words are dropped before they are counted, unless the contexts are too
    many to be sent to every executor.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.when(text.rlike(HINT["token"]), F.regexp_replace(text, TOKEN, " ")).otherwise(text)
    pairs = (
        # only the first and the last piece can be empty
        docs.select(F.split(F.lower(plain), r"[^\p{L}]+").alias("w"))
        .select(F.explode(F.arrays_zip(
            F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p"))
        .where("p.a <> '' and p.b <> ''").select(F.xxhash64("p.a", "p.b").alias("context"))
        .unionByName(places.where("entry").select("context"))
    )

    if n <= LITERALS:
        pairs = pairs.where(F.col("context").isin([r[0] for r in contexts.collect()]))
    elif n <= BROADCAST_ROWS:
        pairs = pairs.join(F.broadcast(contexts), "context", "left_semi")
    counts = pairs.groupBy("context").agg(F.count(F.lit(1)).alias("total"))
    # no semi-join: that would be moved below the counting, and all pairs would be shuffled
    return counts if n <= BROADCAST_ROWS else counts.join(contexts, "context")


def discovered(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, kind, start, end, confidence) of identifiers found by their contexts."""
    places = _places(found)
    seeds = places.where("base").groupBy(
        "kind", "context", F.lower("value").alias("instance")).agg(F.count(F.lit(1)).alias("n"))
    patterns = written(
        seeds.groupBy("kind", "context").agg(
            F.count(F.lit(1)).alias("seeds"), F.sum("n").alias("weight"))
        .where(F.col("seeds") >= MIN_SEEDS), "pii-patterns")
    n = patterns.count()
    counts = written(_corpus_counts(
        docs, text_col, places, patterns.select("context").distinct(), n), "pii-contexts")
    patterns = patterns.join(small(counts, n), "context")
    candidates = written(
        _candidates(places).withColumn("instance", F.lower("core")), "pii-candidates")
    fits = _any([(F.col("kind") == k) & F.col("instance").rlike(r)
                 for k, r in [*SHAPES.items(), *RUN_SHAPES.items()]])
    edges = written(
        candidates.groupBy("context", "instance").agg(F.count(F.lit(1)).alias("n"))
        .join(small(patterns.select("context", "kind", "weight", "total"), n), "context")
        .where(fits), "pii-edges")
    trust = edges.select("kind", "instance").distinct().withColumn("confidence", F.lit(0.0))
    for _ in range(ROUNDS):
        scored = edges.join(trust, ["kind", "instance"]).groupBy(
            "kind", "context", "weight", "total").agg(
            F.sum(F.col("n") * F.col("confidence")).alias("gained")).select(
            "kind", "context", F.least(F.lit(1.0), (F.col("weight") + F.col("gained"))
                                       / F.col("total")).alias("p"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9))))
        trust = edges.join(scored, ["kind", "context"]).groupBy("kind", "instance").agg(
            (1 - F.exp(doubt)).alias("confidence"))
    trust = written(trust.where(F.col("confidence") >= ACCEPT), "pii-trusted")
    rank = F.row_number().over(Window.partitionBy("row", "start", "end").orderBy(
        F.col("confidence").desc(), _number(F.col("kind"))))
    taken = edges.select("kind", "context", "instance").join(trust, ["kind", "instance"])
    in_run = F.max("whole").over(Window.partitionBy("row", "run"))
    return (
        candidates.join(taken, ["context", "instance"])
        .withColumn("in_run", in_run).where("whole or not in_run")
        .withColumn("r", rank).where("r = 1").select("row", "kind", "start", "end", "confidence")
    )


def _number(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row; a span is (no, start, end, kind, base), in order."""
    found = occurrences(docs, id_col, text_col)
    every = (
        found.where("base").select("row", "doc_id", "kind", "start", "end", F.lit(True).alias("base"))
        .unionByName(
            discovered(docs, found, text_col).select(
                "row", F.lit(None).cast("long").alias("doc_id"), "kind", "start", "end",
                F.lit(False).alias("base")))
        .withColumn("no", _number(F.col("kind")))
    )
    span = F.struct("no", "start", "end", "kind", "base")
    gathered = every.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = found.select("row", "doc_id").distinct()
    empty = F.array().cast("array<struct<no:bigint,start:bigint,end:bigint,kind:string,base:boolean>>")
    return rows.join(gathered, "row", "left").select(
        "doc_id", F.coalesce("spans", empty).alias("spans"))


def joined(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and text of all spans, by document."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_discovered"))
