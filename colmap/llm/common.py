"""Expressions that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of a table of keys and numbers that may be sent to every executor
BROADCAST_ROWS = 500_000

#: a run of characters between ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores in front if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its counted ``rows`` are few; else joins shuffle it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Remembered(dict):
    """Results of ``make`` by key; at most ``size`` of them, those of late use.

    There are two generations. When the newer one holds half of ``size`` it becomes
    the older one, whose entries come back when they are asked for again.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.half, self.older = make, max(size // 2, 1), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
