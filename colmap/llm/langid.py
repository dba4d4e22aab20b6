"""Language identification by nearest centroids.

A text becomes a vector of hashed character 1- to 3-grams over its letters,
weighted by TF-IDF and scaled to length one. Each language has several centroids
(spherical k-means over labelled texts); a text gets the language of the centroid
with the largest cosine. A text is rejected if its cosine is below ``margin`` times a
low quantile of the cosines of labelled texts of its length that their centroids were
not learned from: half of the texts are measured with the centroids of the other half.
A centroid whose texts lie further out than those of its length has its own limit.

Cases: null text, empty text and text without letters give ``und``, score 0 and
are rejected; texts are read whole, in pieces of bounded size; ties go to the
first language by name; repeated rows get equal results; without labelled rows
every text is ``und``; other columns are kept and never read.
"""

from __future__ import annotations

import dataclasses
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1 << 12
PIECE = 1 << 20
UNKNOWN = "und"
#: the quantile of held-out cosines that limits a length, and the texts it needs
QUANTILE, ENOUGH = 0.02, 100
RESULT = "lang_pred string, score double, rejected boolean"


@dataclasses.dataclass(frozen=True)
class Model:
    """Centroids by row, the language of each, term weights and distance limits.

    ``floor[k, c]`` is the least cosine with centroid ``k`` at which a text of
    length class ``c`` (binary logarithm of its letters) is accepted.
    """

    centroids: np.ndarray
    languages: tuple[str, ...]
    idf: np.ndarray
    floor: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of hashed 1- to 3-grams of a text, and its number of letters.

    Everything between words counts as one space. Pieces overlap by two
    characters, so that the counts do not depend on where pieces end.
    """
    counts, n_letters = np.zeros(DIMENSIONS, np.int64), 0
    text = (text or "").lower()
    last = np.array([32], np.uint32)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[code]
        n_letters += int(is_letter.sum())
        code = np.concatenate([last, np.where(is_letter, code, np.uint32(32))])
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != 32) | (code[:-1] != 32)
        fresh[:len(last)] = True
        code = code[fresh]
        one = code * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
        k = len(last)
        for grams in (one[k:], two[max(k - 1, 0):], three[max(k - 2, 0):]):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> shift, minlength=DIMENSIONS)
        last = code[-2:]
    return counts, n_letters


def _scaled(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = raw * idf
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means that starts from the texts furthest from one another."""
    chosen = [x.mean(axis=0)]
    for _ in range(min(k, len(x))):
        chosen.append(x[np.argmin(np.max(x @ np.array(chosen).T, axis=1))])
    centres = np.array(chosen[1:])
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[near == i].sum(axis=0) for i in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), 31)


def _train_vectors(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [gram_counts(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "lang": part.column("lang"),
                "letters": pa.array([n for _, n in found], pa.int64()),
                "vector": pa.array(
                    [np.log1p(c).astype(np.float32).tobytes() for c, _ in found], pa.binary()),
            })


def fit(
    docs: DataFrame,
    allowed: Column,
    sample_rows: int = 2000,
    centroids: int = 4,
    margin: float = 0.75,
) -> Model:
    """Learn from rows of ``docs`` (doc_id, text, lang) where ``allowed`` holds.

    ``sample_rows`` bounds the rows learned from: they are shared out evenly over
    the languages, at least 20 each, taken by the hash of doc_id. Counting rows by
    language covers all rows.
    """
    rows = docs.where(allowed & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(np.zeros((0, DIMENSIONS), np.float32), (),
                     np.zeros(DIMENSIONS, np.float32), np.zeros((0, 32)))
    each = max(20, sample_rows // len(sizes))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.3 * each / n)).otherwise(share)
    order = F.xxhash64(F.col("doc_id"), F.lit("learn"))
    first = Window.partitionBy("lang").orderBy("o", "doc_id")
    picked = (
        rows.withColumn("o", order)
        .where(F.pmod("o", F.lit(1 << 20)) < share * (1 << 20))
        .withColumn("r", F.row_number().over(first)).where(F.col("r") <= each)
        .select("lang", "text")
    )
    found = sorted(
        (r["lang"], bytes(r["vector"]), r["letters"])
        for r in picked.mapInArrow(_train_vectors, "lang string, letters long, vector binary")
        .where("letters > 0").collect()
    )
    return _fitted(found, centroids, margin)


def _fitted(found: list[tuple[str, bytes, int]], centroids: int, margin: float) -> Model:
    if not found:
        return Model(np.zeros((0, DIMENSIONS), np.float32), (),
                     np.zeros(DIMENSIONS, np.float32), np.zeros((0, 32)))
    raw = np.frombuffer(b"".join(v for _, v, _ in found), np.float32).reshape(-1, DIMENSIONS)
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    x, langs = _scaled(raw, idf), np.array([lang for lang, _, _ in found])
    lengths = _length_class(np.array([n for _, _, n in found]))
    centres, names = _centroids(x, langs, centroids)
    best = np.argmax(x @ centres.T, axis=1)
    top = _held_out(x, langs, centroids)
    floor = np.zeros((len(centres), 32))
    for c in range(lengths.min(), 32):
        # a length with few texts is judged with those next to it
        apart = np.abs(lengths - c)
        seen = top[apart <= next(d for d in range(32) if (apart <= d).sum() >= min(
            ENOUGH, len(top)))]
        floor[:, c] = margin * np.quantile(seen, QUANTILE)
        for k in range(len(centres)):
            own = top[(lengths == c) & (best == k)]
            if len(own) >= ENOUGH:
                floor[k, c] = min(floor[k, c], margin * np.quantile(own, QUANTILE))
    return Model(centres, names, idf, floor)


def _centroids(x: np.ndarray, langs: np.ndarray, k: int) -> tuple[np.ndarray, tuple[str, ...]]:
    parts, names = [], []
    for lang in sorted(set(langs)):
        centres = _clusters(x[langs == lang], k)
        parts.append(centres)
        names += [str(lang)] * len(centres)
    return np.concatenate(parts).astype(np.float32), tuple(names)


def _held_out(x: np.ndarray, langs: np.ndarray, k: int) -> np.ndarray:
    """The best cosine of each text with centroids learned from the other half."""
    # rows are sorted by language, so both halves have all languages of two or more texts
    half, top = np.arange(len(x)) % 2 == 0, np.zeros(len(x))
    for one in (half, ~half):
        if one.any() and (~one).any():
            top[one] = (x[one] @ _centroids(x[~one], langs[~one], k)[0].T).max(axis=1)
    return top


def predict(text: Column, model: Model) -> Column:
    """A struct (lang_pred, score, rejected) for each text."""
    centroids, names, idf, floor = (
        model.centroids, np.array(model.languages, object), model.idf, model.floor)

    @F.arrow_udf(RESULT)
    def nearest(texts: pa.Array) -> pa.Array:
        langs, scores, rejected = [], [], []
        for at in range(0, len(texts), 256):
            found = [gram_counts(t) for t in texts.slice(at, 256).to_pylist()]
            raw = np.log1p(np.array([c for c, _ in found], np.float32))
            letters = np.array([n for _, n in found])
            if len(names) == 0:
                letters[:] = 0
                cosine = np.zeros((len(found), 1))
            else:
                cosine = _scaled(raw, idf) @ centroids.T
            best = np.argmax(cosine, axis=1)
            top = np.clip(cosine[np.arange(len(found)), best].astype(float), 0, 1)
            for i, n in enumerate(letters):
                langs.append(names[best[i]] if n else UNKNOWN)
                scores.append(top[i] if n else 0.0)
                rejected.append(
                    not n or bool(top[i] < floor[best[i], _length_class(letters[i:i + 1])[0]]))
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
             pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return nearest(text)
