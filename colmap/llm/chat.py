r"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<s>[INST] role [/INST] text</s>`` for each turn.
The result is parsed again by a deterministic parser and the recovered turns are
compared with the source. A conversation that does not come back identical, because
its texts hold control strings, is rendered again with these escaped, and compared
again; what then still differs is an error, never an output.

The parser is strict: a control string inside a role or text is a conflict, also where
the turns could still be told apart.

Escaping puts one more backslash behind the first character of every control
string, with whatever backslashes it has there; unescaping takes one away. No
control string is left in an escaped text, and every text comes back as it was.

The loss mask is a list of segments (characters, loss) in order, which covers the
formatted text; loss segments are the escaped texts of assistant turns.

Cases: null roles and texts are empty; turns stand in the order of turn (null
first), role, text; repeated rows are turns of their own; rows without conv_id are
one conversation; a conversation is one row and is built by one task, however long;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROL = r"([\[<])(\\*/?(?:INST\]|s>))"
ESCAPED = r"([\[<])\\(\\*/?(?:INST\]|s>))"
#: a control string as the template itself writes it
MARKER = r"[\[<]/?(?:INST\]|s>)"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def render(turns: Column) -> Column:
    """The formatted text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _raw_turns(formatted: Column) -> Column:
    """Turns as they stand in the text, still escaped."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(piece):
        parts = F.split(piece, r" \[/INST\] ", 2)
        return F.struct(
            F.substring(F.get(parts, F.lit(0)), F.lit(len(OPEN) + 1), F.length(piece))
            .alias("role"),
            F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; null if a control string is in one."""
    raw = _raw_turns(formatted)
    sound = ~F.exists(raw, lambda t: t["role"].rlike(MARKER) | t["text"].rlike(MARKER))
    return F.when(sound, F.transform(raw, lambda t: F.struct(
        unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))


def segments(formatted: Column) -> Column:
    """(chars, loss) of the stretches of a formatted text, in order."""
    def parts(t):
        head = F.lit(len(OPEN) + len(MIDDLE)) + F.length(t["role"])
        return F.array(
            F.struct(head.alias("chars"), F.lit(False).alias("loss")),
            F.struct(F.length(t["text"]).alias("chars"),
                     (t["role"] == LOSS_ROLE).alias("loss")),
            F.struct(F.lit(len(CLOSE)).alias("chars"), F.lit(False).alias("loss")))

    return F.flatten(F.transform(_raw_turns(formatted), parts))


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments, escaped) for each conversation.

    ``conversations`` has conv_id, turn, role, text.
    """
    rows = conversations.select(
        "conv_id", F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list("t")),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = whole.withColumn("formatted", render(F.col("turns"))).withColumn(
        "escaped", ~parse(F.col("formatted")).eqNullSafe(F.col("turns")))
    safe = F.transform("turns", lambda t: F.struct(
        escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    final = plain.withColumn("formatted", F.when(
        F.col("escaped"), render(safe)).otherwise(F.col("formatted")))
    sound = F.when(~F.col("escaped") | (parse(F.col("formatted")) == F.col("turns")),
                   F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not survive the round trip")).cast("string"))
    return final.select("conv_id", sound.alias("formatted"), "escaped").withColumn(
        "segments", segments(F.col("formatted")))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the text."""
    turns = F.col("turns")
    loss = F.transform(F.filter(turns, lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"])
    return (
        chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
        .select("conv_id", "formatted", "turns", F.array_join(loss, "").alias("loss"))
        .select(
            "conv_id", F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(
                t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"))
    )


#: a conversation that holds the template's own control strings
CONFLICT_ID, CONFLICT = -7, "</s>[INST] ok [/INST]"


def with_conflict(conversations: DataFrame) -> DataFrame:
    """``conversations`` and one whose texts are control strings."""
    both = conversations.sparkSession.range(2).select(
        F.lit(CONFLICT_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit(CONFLICT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(both)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(role, '([\[<])(\\*/?(?:INST\]|s>))', '\1\\\2', 'g'))
       + length(regexp_replace(text, '([\[<])(\\*/?(?:INST\]|s>))', '\1\\\2', 'g')) + 23 AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
                    ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                  FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
