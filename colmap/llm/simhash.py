"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most ``d``
of their eight bytes, so at least ``8 - d`` bytes are equal in place. The index
maps (byte positions, their values) to fingerprints; for every pair that shares
an entry the equal bytes are tallied, pairs below ``8 - d`` are dropped, and the
rest are verified bit by bit.

An entry for a single byte would list one fingerprint in 256 and make the work
quadratic, so entries hold several bytes, chosen so that no pair is missed. For
``d = 3`` they are the 14 planes of four positions whose numbers add up to zero
without carry: any three positions lie on exactly one such plane, and the four
positions beside it are a plane too, whose bytes the pair then shares.

Equal fingerprints are one row of the index. An entry with more fingerprints than
``POSTING`` is split by a fifth equal byte, which a linking pair also has; over three
bits it need not have one, and entries are linked whole. Pairs
within an entry are never written: a task links them in place and emits a
spanning forest.

Cases: null, empty and blank texts have fingerprint zero and link like any other;
texts are hashed whole, piece by piece; rows without doc_id keep a null doc_id and
count for linking, and ``component_id`` is null only if no row of the component
has an id; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmap.llm.common import free_name, quoted, small
from colmap.llm.components import components
from colmap.session import written

SEED = 42
BYTES = 8
PIECE = 1 << 15
POSTING = 4096
BUFFER = 1 << 16


def fingerprint_of(text: str | None, shingle: int) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:n].tolist(), ends[len(words) - n:].tolist()
    tally = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, PIECE):
        pairs = zip(first[at:at + PIECE], last[at:at + PIECE])
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in pairs])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BYTES), axis=1)
        tally += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(tally * 2 > n).tobytes(), "big")


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of each text as a long with the same 64 bits."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in texts), np.uint64)
        return pa.array(found.view(np.int64))

    return hashed(text)


def as_hex(value: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def key_positions(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, of which any close pair shares at least one."""
    if not 0 <= max_bits < BYTES:
        raise ValueError("max_bits must be from 0 to 7")
    if max_bits <= 3:
        return [p for p in combinations(range(BYTES), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
    return list(combinations(range(BYTES), BYTES - max_bits))


def _mask(positions) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _entries(fingerprints: DataFrame, keys: list[tuple[int, ...]]) -> DataFrame:
    """One row per fingerprint and entry, those of an entry together and in order."""
    listed = fingerprints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("bytes"))
        for i, p in enumerate(keys)])).alias("e")).select("e.k", "e.bytes", "fp")
    return listed.repartition("k", "bytes").sortWithinPartitions("k", "bytes", "fp")


def _forest(fp: np.ndarray, run: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Positions to link so that close fingerprints of a run are connected.

    Compares each position with the next, the second next and so on, only where
    the run is that long, all runs at once.
    """
    root = np.arange(len(fp))
    at, step, left, right = root, 0, [], []
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            return left, right
        apart = at[root[at] != root[at + step]]
        differing = fp[apart] ^ fp[apart + step]
        shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        enough = shared >= BYTES - max_bits
        apart, differing = apart[enough], differing[enough]
        close = apart[np.bitwise_count(differing) <= max_bits]
        for i in close.tolist():
            a, b = i, i + step
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
        if len(close):
            while not np.array_equal(up := root[root], root):
                root = up


LINKS = "a long, b long, over boolean"


def _linker(max_bits: int, longest: int | None):
    """Turns sorted entries into links; entries over ``longest`` come back whole."""

    def link(batches):
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray):
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            run = np.cumsum(new) - 1
            size = np.bincount(run)[run]
            if longest is not None:
                yield pack(rows[size > longest, 2], None)
                keep = (size > 1) & (size <= longest)
            else:
                keep = size > 1
            fp = rows[keep, 2]
            left, right = _forest(fp.view(np.uint64), run[keep], max_bits)
            yield pack(fp[left], fp[right])

        def pack(a, b):
            return pa.RecordBatch.from_pydict({
                "a": pa.array(a, pa.int64()),
                "b": pa.array(a if b is None else b, pa.int64()),
                "over": pa.array(np.full(len(a), b is None), pa.bool_()),
            })

        n_held, enough, known = 0, BUFFER, None
        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            if known is not None:  # an entry already found too long goes on
                more = (rows[:, :2] == known).all(axis=1)
                yield pack(rows[more, 2], None)
                rows = rows[~more]
            held.append(rows)
            n_held += len(rows)
            if n_held < enough:
                continue
            rows = np.concatenate(held)
            # the last entry may go on in the next batch
            cut = int(np.argmax((rows[:, :2] == rows[-1, :2]).all(axis=1)))
            if cut:
                yield from flush(rows[:cut])
            rows, known = rows[cut:], None
            if longest is not None and len(rows) > longest:
                known = rows[-1, :2].copy()
                yield pack(rows[:, 2], None)
                rows = rows[:0]
            held, n_held, enough = [rows], len(rows), max(BUFFER, 2 * len(rows))
        if n_held:
            yield from flush(np.concatenate(held))

    return link


def links(fingerprints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (``fp``) in reach."""
    keys = key_positions(max_bits)
    finer = sorted({tuple(sorted({*p, q})) for p in keys for q in range(BYTES) if q not in p})
    # a pair may differ in all bytes that a finer key would add
    splits = max_bits <= BYTES - len(finer[0])
    first = written(
        _entries(fingerprints, keys).select("k", "bytes", "fp")
        .mapInArrow(_linker(max_bits, POSTING if splits else None), LINKS), "simhash-links")
    if not splits:
        return first.select("a", "b")
    over = first.where("over").select(F.col("a").alias("fp")).distinct()
    second = _entries(over, finer).mapInArrow(_linker(max_bits, None), LINKS)
    return first.where("not over").union(second).select("a", "b")


def classes(marked: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, first): each distinct fingerprint and the least ``pick`` in its reach.

    ``marked`` has one row per document: its fingerprint ``fp`` and any orderable
    ``pick``.
    """
    nodes = written(marked.groupBy("fp").agg(F.min("pick").alias("least")), "distinct")
    roots = written(components(links(nodes.select("fp"), max_bits)), "roots")
    placed = nodes.join(roots, nodes["fp"] == roots["u"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    return placed.join(placed.groupBy("root").agg(F.min("least").alias("first")), "root").select(
        "fp", "first")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint: long, component_id) for each row of ``docs``."""
    marked = written(
        docs.select(F.col(id_col).alias("pick"),
                    fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    return marked.join(classes(marked, max_bits), "fp").select(
        F.col("pick").alias("doc_id"), F.col("fp").alias("fingerprint"),
        F.col("first").alias("component_id"))


def keep_one(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with one row left of each group of near-duplicates.

    The row with the least id stays, of several any one. What to drop is found from
    (id, hash of the text, fingerprint) alone and taken out of ``docs`` by these
    keys; rows that repeat both id and text are told apart only where they stay.
    """
    doc_id, same = quoted(id_col), F.xxhash64(quoted(text_col))
    marked = written(docs.select(
        F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), same.alias("same"))
        .alias("pick"), fingerprint(quoted(text_col), shingle).alias("fp")), "fingerprints")
    keys = marked.groupBy("pick", "fp").agg(F.count(F.lit(1)).alias("n")).join(
        classes(marked, max_bits), "fp")
    out = written(keys.where("pick != first").select("pick"), "simhash-dropped")
    repeated = written(keys.where("pick = first and n > 1").select("pick"), "simhash-repeated")
    n_out, n_repeated = out.count(), repeated.count()
    pick, key = free_name(docs, "pick"), F.struct(
        doc_id.isNull().alias("none"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), same.alias("same"))

    def keyed(df):
        return df.select(F.struct(
            F.col("pick.none").alias("none"), F.coalesce(F.col("pick.id").cast("string"), F.lit("")).alias("id"),
            F.col("pick.same").alias("same")).alias(pick))

    rows = docs.withColumn(pick, key).join(small(keyed(out), n_out), pick, "left_anti")
    once = rows.join(small(keyed(repeated), n_repeated), pick, "left_anti")
    twice = rows.join(small(keyed(repeated), n_repeated), pick, "left_semi").dropDuplicates([pick])
    return once.union(twice).select(*[quoted(c) for c in docs.columns])
