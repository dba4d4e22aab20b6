"""Runs of words that repeat with a period, and texts without the repeats.

A run is a longest stretch of words with smallest period q, at least ``copies`` times
q and ``least`` words long. Words become numbers; texts of like length are laid end to
end with a number of its own behind each, so that nothing reaches from one into the
next.

The search goes through dyadic scales. At scale B the words are cut into blocks of B,
and the sums of squared differences of each block with the window that follows it, at
all distances from B to 2B - 1, come from one integer number-theoretic transform per
block. A sum of zero (modulo the transform's prime) is an occurrence with no mismatch;
a run with a period in that range holds two neighbouring blocks that both have one at
the distance of the period. Such distances are seeds: the words are compared outwards
from them until they differ, which also refutes sums that are zero only modulo the
prime. A block that occurs three times or more has a shorter period itself, and all
its occurrences lie in one stretch of that period; then only the distances that carry
the ends of its own such stretch to the ends of theirs can be periods of a run. So a
block has two seeds at most, and the work is that of the transforms: n log n a scale.

Cases: null, empty and blank texts and texts of fewer than ``least`` words have no
runs; the text without repeats is then all words joined by one space, or empty; very
long texts are searched whole, in slices of blocks of bounded size; repeated rows and
copies are searched one by one; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "struct<start long, length long, period long>"
FOUND = f"struct<runs array<{RUN}>, collapsed string>"
#: 15 * 2**27 + 1 and a generator of its units
PRIME = 2013265921
ROOT = 31
_P = np.uint64(PRIME)
#: transforms are taken apart into ones of this size, many at a time
INNER = 64
#: numbers in a slice of blocks, and words of short texts searched together
SLICE = 1 << 20
TOGETHER = 1 << 18


# ---- the transform

@cache
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The powers of a root of unity of order ``2 * half``."""
    root = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    found = np.ones(1, np.uint64)
    while len(found) < half:
        step = np.uint64(pow(root, len(found), PRIME))
        found = np.concatenate([found, found * step % _P])
    return found[:half]


def _forward_step(x, y, powers):
    total = x + y
    apart = (x + (_P - y)) * powers % _P
    x[...] = np.minimum(total, total - _P)
    y[...] = apart


def _inverse_step(x, y, powers):
    turned = y * powers % _P
    y[...] = x + (_P - turned)
    x += turned
    np.minimum(x, x - _P, out=x)
    np.minimum(y, y - _P, out=y)


def forward(rows: np.ndarray) -> np.ndarray:
    """Transforms of all rows, in an order that ``inverse`` undoes."""
    count, size = rows.shape
    half = size // 2
    while half >= INNER:
        view = rows.reshape(count, -1, 2, half)
        _forward_step(view[:, :, 0], view[:, :, 1], _powers(half, False))
        half //= 2
    inner = min(size, INNER)
    turned = np.ascontiguousarray(rows.reshape(-1, inner).T)
    while half:
        view = turned.reshape(-1, 2, half, turned.shape[1])
        _forward_step(view[:, 0], view[:, 1], _powers(half, False)[:, None])
        half //= 2
    return turned


def inverse(turned: np.ndarray, size: int) -> np.ndarray:
    """Rows times ``size`` from their transforms."""
    inner, half = min(size, INNER), 1
    while half < inner:
        view = turned.reshape(-1, 2, half, turned.shape[1])
        _inverse_step(view[:, 0], view[:, 1], _powers(half, True)[:, None])
        half *= 2
    rows = np.ascontiguousarray(turned.T).reshape(-1, size)
    while half < size:
        view = rows.reshape(len(rows), -1, 2, half)
        _inverse_step(view[:, :, 0], view[:, :, 1], _powers(half, True))
        half *= 2
    return rows


def matches(words: np.ndarray, squares: np.ndarray, block: int, first: int, last: int):
    """Which of the blocks ``first`` to ``last`` occur at which distance.

    Entry (j, o) says whether block ``first + j`` and the words ``block + o`` behind it
    have a sum of squared differences of zero modulo the prime. ``words`` has three
    blocks more than are asked for; ``squares`` are the sums of squares before each.
    """
    size, count = 2 * block, last - first
    at = np.arange(first, last)[:, None] * block
    blocks = np.zeros((count, size), np.uint64)
    # turned around, so that the product of the transforms gives sums over i of p[i] w[i + d]
    blocks[:, 0] = words[at[:, 0]]
    blocks[:, block + 1:] = words[at + np.arange(block - 1, 0, -1)]
    windows = words[at + block + np.arange(size)]
    windows[:, -1] = 0
    product = inverse(forward(blocks) * forward(windows) % _P, size)[:, :block]
    ends = at + block + np.arange(block)
    total = squares[ends + block] - squares[ends] + (squares[at + block] - squares[at])
    return total % _P * np.uint64(size) % _P == np.uint64(2) * product % _P


# ---- runs from seeds

def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two arrays are equal."""
    at, step, n = 0, 32, min(len(a), len(b))
    while at < n:
        end = min(at + step, n)
        apart = a[at:end] != b[at:end]
        first = int(apart.argmax())
        if apart[first]:
            return at + first
        at, step = end, min(2 * step, 1 << 16)
    return n


class Stretches:
    """Longest stretches of positions whose words recur at a distance."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.last: dict[tuple[int, int], tuple[int, int]] = {}

    def around(self, at: int, distance: int, slot: int = 0) -> tuple[int, int] | None:
        """The stretch that ``at`` lies in; the last one found is remembered."""
        known = self.last.get((distance, slot))
        if known is not None and known[0] <= at < known[1]:
            return known
        x = self.words
        right = at + _alike(x[at:], x[at + distance:])
        if right == at:
            return None
        left = at - _alike(x[:at][::-1], x[:at + distance][::-1][:at])
        self.last[distance, slot] = left, right
        return left, right


def _has_shorter(words: np.ndarray, start: int, period: int) -> bool:
    """Has a stretch of several periods a period that divides this one?"""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if np.array_equal(words[start:start + period - part],
                              words[start + part:start + period]):
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def find_runs(words: np.ndarray, longest: int, copies: int, least: int) -> list[tuple]:
    """(start, length, period) of all runs in ``words``, by start, then period.

    ``longest`` bounds the length of a run.
    """
    n = len(words)
    found = set()
    stretches = Stretches(words)
    block = 1
    while copies * block <= longest:
        padded = np.zeros(n + 4 * block, np.uint64)
        padded[:n] = words
        squares = np.zeros(len(padded) + 1, np.uint64)
        np.cumsum(padded * padded % _P, out=squares[1:])
        whole, step = n // block, max(SLICE // (2 * block), 2)
        for first in range(0, whole - 1, step):
            zero = matches(padded, squares, block, first, min(first + step + 1, whole))
            both = zero[:-1] & zero[1:]
            for j in np.flatnonzero(both.any(axis=1)).tolist():
                at = (first + j) * block
                for d in _seeds(stretches, at, block + np.flatnonzero(both[j])):
                    known = stretches.around(at, d)
                    if known is None:
                        continue
                    start, length = known[0], known[1] - known[0] + d
                    run = start, length, d
                    if length >= max(least, copies * d) and run not in found \
                            and not _has_shorter(words, start, d):
                        found.add(run)
        stretches.last.clear()
        block *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _seeds(stretches: Stretches, at: int, distances: np.ndarray) -> list[int]:
    """The distances at which the block at ``at`` may belong to a run."""
    if len(distances) < 3:
        return distances.tolist()
    short = int(distances[1] - distances[0])
    own = stretches.around(at, short, 1)
    other = stretches.around(at + int(distances[0]), short, 2)
    if own is None or other is None:  # a sum was zero modulo the prime only
        return distances.tolist()
    if own == other:
        return []
    asked = {other[0] - own[0], other[1] - own[1]}
    return sorted(asked & set(distances.tolist()))


# ---- texts

def _search(lists: pa.ListArray, copies: int, least: int) -> list[list[tuple]]:
    """The runs of each list of words."""
    found: list[list[tuple]] = [[] for _ in range(len(lists))]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(0, offsets[-1]).dictionary_encode()
    words = values.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    groups: dict[int, list[int]] = {}
    for i in np.flatnonzero(sizes >= least).tolist():
        groups.setdefault(int(sizes[i]).bit_length(), []).append(i)
    for group in groups.values():
        while group:
            some, held = [], 0
            while group and held < TOGETHER:
                some.append(group.pop())
                held += int(sizes[some[-1]]) + 1
            joined = np.empty(held, np.uint64)
            starts, at = [], 0
            for k, i in enumerate(some):
                size = int(sizes[i])
                starts.append(at)
                joined[at:at + size] = words[offsets[i]:offsets[i + 1]]
                joined[at + size] = len(values.dictionary) + k
                at += size + 1
            longest = int(sizes[some].max())
            for start, length, period in find_runs(joined, longest, copies, least):
                k = int(np.searchsorted(starts, start, "right")) - 1
                found[some[k]].append((start - starts[k], length, period))
    return found


def _collapsed(lists: pa.ListArray, runs: list[list[tuple]]) -> pa.Array:
    """The words of each list that no run repeats, joined by one space."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    keep = np.ones(offsets[-1], bool)
    for i, own in enumerate(runs):
        for start, length, period in own:
            keep[offsets[i] + start + period:offsets[i] + start + length] = False
    before = np.concatenate([[0], np.cumsum(keep)])
    kept = lists.values.slice(0, offsets[-1]).filter(pa.array(keep))
    return pc.binary_join(pa.ListArray.from_arrays(
        pa.array(before[offsets], pa.int32()), kept), " ")


def runs(words: Column, copies: int = 4, least: int = 6) -> Column:
    """(runs, collapsed) of each array of words; null counts as no words."""

    @F.arrow_udf(FOUND)
    def search(lists: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, max(len(lists), 1), 1024):
            part = lists.slice(at, 1024)
            # offsets from zero
            part = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(
                    pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))]),
                    pa.int32()), part.flatten())
            found = _search(part, copies, least)
            listed = pa.array(
                [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found],
                pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))
            parts.append(pa.StructArray.from_arrays(
                [listed, _collapsed(part, found)], ["runs", "collapsed"]))
        return pa.concat_arrays(parts)

    return search(F.coalesce(words, F.array().cast("array<string>")))


def strongest(found: Column) -> Column:
    """The run of greatest exponent; the first of equal ones, null if there is none."""
    first = F.when(F.size(found) > 0, F.get(found, 0))
    return F.reduce(found, first, lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
