"""Finding the mapping object inside a model's reply (row-local helper)."""

from __future__ import annotations

import json
import re
import sys
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle

from colmap.functions import vocab

# Tasks carry these functions with them, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(vocab)

ENTRY_TYPE = pa.struct(
    [
        ("pos", pa.int32()),
        ("field", pa.string()),
        ("value", pa.string()),
        ("is_string", pa.bool_()),
        ("value_json", pa.string()),
    ]
)


def _decode(text: str, start: int):
    """The JSON value that begins at ``start``, or None."""
    try:
        return json.JSONDecoder().raw_decode(text, start)[0]
    except json.JSONDecodeError:
        return None


def _object_in(text: str):
    """A fenced object if it parses, else the object at the first brace.

    Only the first brace counts: when no object starts there the search is over.
    """
    fence = re.search(vocab.FENCED_OBJECT, text, re.DOTALL)
    if fence:
        try:
            return json.loads(fence.group(1))
        except json.JSONDecodeError:
            pass
    brace = text.find("{")
    return None if brace < 0 else _decode(text, brace)


def _thought(text: str) -> str:
    """What the first closed think block holds."""
    inside, closed, _ = text.partition(vocab.THINK_OPEN)[2].partition(vocab.THINK_CLOSE)
    return inside if closed else ""


def _outside(text: str) -> str:
    """Text without its think blocks; one that stays open runs to the end."""
    kept, opened = [], vocab.THINK_OPEN
    while opened:
        before, opened, rest = text.partition(vocab.THINK_OPEN)
        kept.append(before)
        _, closed, text = rest.partition(vocab.THINK_CLOSE)
        if not closed:
            break
    return "".join(kept).partition(vocab.THINK_OPEN)[0]


def strict(text: str):
    """Look in the whole text, then in the first think block, then outside of
    think blocks. An empty object counts in the last place only."""
    text = re.sub(vocab.BROKEN_KEY, r'"\1_\2":', text)
    return _object_in(text) or _object_in(_thought(text)) or _object_in(_outside(text))


def lenient(text: str):
    """Cut out the first fence if there is one and parse the rest; failing that,
    parse from the first to the last brace."""
    for fence in ("```json", "```"):
        _, opened, rest = text.partition(fence)
        if opened:
            text = rest.partition("```")[0].strip()
            break
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        pass
    first, last = text.find("{"), text.rfind("}")
    if 0 <= first < last:
        try:
            return json.loads(text[first : last + 1])
        except json.JSONDecodeError:
            pass
    return None


def mapping_in(raw: str | None, mode: str) -> dict | None:
    """The mapping in a reply; None when it holds no usable object."""
    if raw is None:
        return None
    try:
        found = strict(raw) if mode == "strict" else lenient(raw)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and "task" in found else None


def _utf8(text: str) -> str:
    """Lone surrogates have no UTF-8 form."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_as_json = json.JSONEncoder(ensure_ascii=False).encode


def entries_column(mode: str):
    """Arrow function from a column of replies to a column of mapping entries."""

    def parse(raw: pa.Array) -> pa.Array:
        found = [mapping_in(text, mode) for text in raw.to_pylist()]
        pairs = [pair for mapping in found for pair in (mapping or {}).items()]
        values = [value for _, value in pairs]
        strings = [isinstance(v, str) for v in values]
        structs = pa.StructArray.from_arrays(
            [
                pa.array([pos for m in found for pos in range(len(m or ()))], pa.int32()),
                pa.array([_utf8(field) for field, _ in pairs], pa.string()),
                pa.array([_utf8(v) if s else None for v, s in zip(values, strings)], pa.string()),
                pa.array(strings, pa.bool_()),
                pa.array([_utf8(_as_json(v)) for v in values], pa.string()),
            ],
            fields=list(ENTRY_TYPE),
        )
        ends = list(accumulate((len(m or ()) for m in found), initial=0))
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), structs, mask=pa.array([m is None for m in found])
        )

    parse.__annotations__ = {"raw": pa.Array, "return": pa.Array}
    return parse
