"""Token ids in files of directly addressable codes.

A file holds a run of documents in ascending doc_id order:

    magic, version and counts     little-endian unsigned 64-bit integers
    document table                doc_id and first token of each document, and the end
    levels                        of each: chunk bytes, continuation bitmap, rank directory

An id is split into 8-bit chunks, least significant first. Level 0 has the first
chunk of every id, and a bitmap that says whether the id goes on; level 1 has the
second chunk of the ids that go on, and so on. The rank directory holds the number
of set bits before each block of 512 bits, so token ``i`` is found by one lookup
per level, without decoding anything else.

Documents are spread over files by ranges of doc_id, so that a file needs no more
than its own range. Each task writes one file at a time under a name of its own and
renames it when it is complete; the name of the file that counts is in the manifest
which Spark commits, so tasks that run twice do no harm.

Cases: null text is empty; every document has the end id, so no document is without
ids; null doc_ids come first; rows with equal ids stand in the order of their text's
hash; very long texts are encoded whole; an empty table gives no files and no rows;
other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colmap.llm.common import Remembered
from colmap.session import scratch_path, written

MAGIC = b"DACTOK01"
HEADER = struct.Struct("<8s4Q")
NO_ID = np.iinfo(np.int64).min
BLOCK_BITS = 512
END = 1
#: a file is closed when it has this many ids
FILE_TOKENS = 1 << 21
#: ids that a reader decodes at a time
READ_TOKENS = 1 << 20
#: runs of letters or others whose ids a worker remembers
CACHE_WORDS = 500_000

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


# ---- encoding texts

class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The tokenizer drops white space, puts letters in lower case and never joins letters
    with other characters. So a text falls into runs of letters and runs of others, and
    each run is encoded once and then looked up; runs of letters by the tokenizer's
    model alone, which spares most of the time. Words with an apostrophe, with ``<``
    (special tokens) or with letters beyond Latin go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = self._is_expected()
        self.known = Remembered(self._run_ids, CACHE_WORDS)

    def _is_expected(self) -> bool:
        """Whether the short way gives what the whole tokenizer gives."""
        letters = ("word", "Straße", "Éléphant", "ªºµ", "x" * 40)
        others = (".", "...", "12", ",-3", "?!", "(", "^°")
        return all(self._ids(a) == self._model_ids(a.lower()) for a in letters) and all(
            self._ids(a + b + c) == self._ids(a) + self._ids(b) + self._ids(c)
            for a in letters for b in others for c in letters)

    def _ids(self, word: str) -> bytes:
        encoded = self.tokenizer.encode(word, add_special_tokens=False)
        return np.array(encoded.ids, "<u4").tobytes()

    def _model_ids(self, word: str) -> bytes:
        units = word.encode().decode("latin-1").translate(BYTE_UNITS)
        return np.array([t.id for t in self.model.tokenize(units)], "<u4").tobytes()

    def _run_ids(self, run: str) -> bytes:
        return self._model_ids(run) if self.plain and LETTER_RUN.fullmatch(run) else self._ids(run)

    def _runs(self, text: str) -> list[str]:
        if self.plain and not ODD.search(text):
            return RUNS.findall(text.lower())
        runs = []
        for word in WORDS.findall(text):
            if not self.plain or ODD.search(word):
                runs.append(word)
            else:
                runs += RUNS.findall(word.lower())
        return runs

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        known = self.known.__getitem__
        return [b"".join(map(known, self._runs(t or ""))) for t in texts]


#: characters whose words go through the whole tokenizer
ODD = re.compile("['<\u0130\u0180-\U0010ffff]")
_LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c != "\u0130")
LETTER_RUN = re.compile(f"[{_LETTERS}]+")
RUNS = re.compile(f"[{_LETTERS}]+|[^{_LETTERS} \t-\r]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _byte_units() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_UNITS = _byte_units()


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---- the file format

def _level(chunks: np.ndarray, goes_on: np.ndarray) -> bytes:
    bitmap = np.packbits(goes_on, bitorder="little")
    padded = np.zeros(-(-len(chunks) // BLOCK_BITS) * (BLOCK_BITS // 8), np.uint8)
    padded[:len(bitmap)] = bitmap
    ones = _POPCOUNT[padded].reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
    ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.uint64)]).astype("<u8")
    return chunks.tobytes() + padded.tobytes() + ranks.tobytes()


def encode_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of a file with these documents."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([len(i) // 4 for i in ids], dtype=np.uint64)
    levels, rest = [], tokens
    while len(rest):
        goes_on = rest > 0xFF
        levels.append((len(rest), _level((rest & 0xFF).astype(np.uint8), goes_on)))
        rest = rest[goes_on] >> 8
    table = np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    starts = np.concatenate([[0], ends]).astype("<u8").tobytes()
    sizes = np.array([n for n, _ in levels], "<u8").tobytes()
    head = HEADER.pack(MAGIC, 1, len(doc_ids), len(tokens), len(levels))
    return head + table + starts + sizes + b"".join(b for _, b in levels)


class TokenFile:
    """Random access to the tokens and documents of a file.

    ``source`` is a seekable binary file; only what is asked for is read.
    """

    def __init__(self, source):
        self.source = source
        magic, _, self.n_docs, self.n_tokens, n_levels = HEADER.unpack(self._bytes(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.table, self.starts = at, at + 8 * self.n_docs
        at = self.starts + 8 * (self.n_docs + 1)
        self.levels = []
        sizes = self._numbers(at, n_levels, "<u8")
        at += 8 * n_levels
        for n in sizes.tolist():
            blocks = -(-n // BLOCK_BITS)
            bitmap = at + n
            ranks = bitmap + blocks * BLOCK_BITS // 8
            self.levels.append((at, bitmap, ranks))
            at = ranks + 8 * (blocks + 1)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _numbers(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._bytes(at, n * np.dtype(kind).itemsize), kind)

    def documents(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids of ``n`` documents, and where each starts, and the end of the last."""
        return (self._numbers(self.table + 8 * first, n, "<i8"),
                self._numbers(self.starts + 8 * first, n + 1, "<u8").astype(np.int64))

    def _rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before position ``i``."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK_BITS
        before = int(self._numbers(ranks + 8 * block, 1, "<u8")[0])
        bits = np.frombuffer(self._bytes(bitmap + block * BLOCK_BITS // 8, BLOCK_BITS // 8),
                             np.uint8)
        return before + int(np.unpackbits(bits, bitorder="little")[:i % BLOCK_BITS].sum())

    def token(self, i: int) -> int:
        """Token ``i``, by one lookup per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, level = 0, 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            value |= self._bytes(chunks + i, 1)[0] << (8 * level)
            if not self._bytes(bitmap + i // 8, 1)[0] >> (i % 8) & 1:
                return value
            i, level = self._rank(level, i), level + 1

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Tokens ``first`` to ``last``, exclusive, as unsigned 32-bit integers."""
        out = np.zeros(last - first, "<u4")
        where = np.arange(last - first)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if first >= last:
                break
            out[where] |= self._numbers(chunks + first, last - first, "u1").astype("<u4") \
                << np.uint32(8 * level)
            raw = self._numbers(bitmap + first // 8, -(-last // 8) - first // 8, "u1")
            goes_on = np.unpackbits(raw, bitorder="little")[
                first % 8:first % 8 + last - first].astype(bool)
            where = where[goes_on]
            if not len(where):
                break
            first = self._rank(level, first)
            last = first + len(where)
        return out


# ---- files on shared storage

def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the file system that Spark puts it on.

    Workers must not take a path without one for a folder of their own disk.
    """
    if "://" in folder or folder.startswith("file:"):
        return folder
    spark.range(1).coalesce(1).write.parquet(f"{folder}-place")
    found = spark.read.parquet(f"{folder}-place").inputFiles()[0]
    return f"{found.rsplit('-place/', 1)[0]}"


def _write(folder: str, name: str, content: bytes) -> str:
    """Write a file so that it is either whole or absent."""
    files, at = _filesystem(folder)
    files.create_dir(at, recursive=True)
    part = f"{at}/.{name}.part"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, f"{at}/{name}")
    return f"{folder}/{name}"


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, local long, n_tokens long, ids_crc32 long, part int, seq int"


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id",
    text_col: str = "text", end: int = END, file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the token files of ``docs``; returns their manifest (written, in order).

    (part, seq) orders the files by doc_id; ``base`` is the number of ids in all
    files before.
    """
    tail = np.array([end], "<u4").tobytes()
    folder = qualified(docs.sparkSession, folder)

    def encode(batches):
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), encoder(tokenizer)
        doc_ids, ids, held, seq = [], [], 0, 0

        def close():
            name = f"tokens-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:8]}.dac"
            path = _write(folder, name, encode_file(doc_ids, ids))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "path": [path], "n_docs": pa.array([len(ids)], pa.int64()),
                "n_tokens": pa.array([held], pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts = rows.column("text").to_pylist()
                for d, found in zip(rows.column("doc_id").to_pylist(), words.encode(texts),
                                    strict=True):
                    doc_ids.append(d)
                    ids.append(found + tail)
                    held += len(found) // 4 + 1
                    if held >= file_tokens:
                        yield close()
                        doc_ids, ids, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    manifest = written(
        rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text").mapInArrow(encode, MANIFEST), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from its file.

    Each file is read by one task, a bounded number of ids at a time.
    """

    def decode(batches):
        for batch in batches:
            for part, seq, path in zip(*(batch.column(c).to_pylist()
                                         for c in ("part", "seq", "path")), strict=True):
                files, at = _filesystem(path)
                with files.open_input_file(at) as source:
                    yield from _documents(TokenFile(source), part, seq)

    found = manifest.select("part", "seq", "path")
    n = found.count()
    spread = found.repartitionByRange(n, "part", "seq") if n > 1 else found
    base = manifest.select(F.col("part").alias("p"), F.col("seq").alias("s"), "base")
    read = spread.mapInArrow(decode, DOCUMENTS)
    return read.join(base, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _documents(file: TokenFile, part: int, seq: int) -> Iterator[pa.RecordBatch]:
    for first in range(0, file.n_docs, 1024):
        doc_ids, starts = file.documents(first, min(1024, file.n_docs - first))
        sums = [0] * len(doc_ids)
        whole = starts[-1] - starts[0] <= READ_TOKENS
        ids = file.tokens(int(starts[0]), int(starts[-1])) if whole else None
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            if whole:
                sums[i] = zlib.crc32(ids[a - starts[0]:b - starts[0]].tobytes())
                continue
            for at in range(a, b, READ_TOKENS):
                sums[i] = zlib.crc32(file.tokens(at, min(b, at + READ_TOKENS)).tobytes(), sums[i])
        n = len(doc_ids)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID),
            "local": pa.array(starts[:-1]), "n_tokens": pa.array(np.diff(starts)),
            "ids_crc32": pa.array(sums, pa.int64()),
            "part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32())})


def tokenized(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    return read_documents(write_tokens(docs, tokenizer, scratch_path(spark, "tokens")))
