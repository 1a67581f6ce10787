"""Importance resampling towards a target corpus, with bit-sliced weights.

Documents and target are bags of word n-grams hashed into buckets. A bucket's gain is the scaled
logarithm of how much more often the target has it. A document's weight is the sum of the gains of
its features: its bucket counts are cut into bit planes, and so are the positive and the negative
gains; two planes contribute the number of bits they share times their powers of two. Gumbel noise
from the document's id makes the highest scores a sample without replacement by weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlab.llm.common import text_key
from threadlab.session import materialise

BUCKETS = 10_000
GRAMS = 3
SCALE = 1_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
KNOWN = 64  # lengths of a word for which the CRC step is tabled
PART = 1 << 20  # bytes of a text whose words are handled at once

# What is left of a text: digits, letters (A-Z as a-z) and bytes beyond ASCII; a blank for the rest.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@lru_cache(maxsize=4 * KNOWN)
def _steps(n: int) -> np.ndarray:
    """The register after ``n`` zero bytes is the XOR of one entry for each of its bytes: (4, 256)."""
    if n == 1:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
        rows = [table]
        for shift in (0, 8, 16):  # a byte further up moves down by one
            rows.append(np.arange(256, dtype=np.uint32) << np.uint32(shift))
        return np.stack(rows)
    half = _steps(n // 2)
    out = _apply(half, half)
    return _apply(_steps(1), out) if n % 2 else out


def _apply(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    return (
        table[0][register & 255] ^ table[1][(register >> 8) & 255]
        ^ table[2][(register >> 16) & 255] ^ table[3][register >> 24]
    )


@lru_cache(maxsize=1)
def _all_steps() -> np.ndarray:
    """The tables of 0 to ``KNOWN`` bytes, flat; the first one changes nothing."""
    same = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    return np.stack([same, *(_steps(n) for n in range(1, KNOWN + 1))]).ravel()


def moved(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the CRC-32 of a string becomes in that of the string and ``count`` more bytes, without those."""
    tables = _all_steps()
    base = np.minimum(count, KNOWN) * 1024
    out = (
        tables[base + (crc & 255)] ^ tables[base + 256 + ((crc >> 8) & 255)]
        ^ tables[base + 512 + ((crc >> 16) & 255)] ^ tables[base + 768 + (crc >> 24)]
    )
    far = np.flatnonzero(count > KNOWN)
    for size in np.unique(count[far]).tolist():
        at = far[count[far] == size]
        out[at] = _apply(_steps(size), crc[at])
    return out


def feature_buckets(words: list[bytes], grams: int = GRAMS, new: int = 0) -> np.ndarray:
    """Bucket of every run of 1 to ``grams`` words that ends after the first ``new`` words.

    The CRC of a run follows from the CRC of the run without its last word, and that word's.
    """
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    spaced = moved(np.full(len(words), zlib.crc32(b" "), np.uint32), size) ^ own
    crc, found = own, [own[new:]]
    for n in range(1, min(grams, len(words))):
        crc = moved(crc[:-1], size[n:] + 1) ^ spaced[n:]
        found.append(crc[max(new - n, 0):])
    return np.concatenate(found).astype(np.int64) % BUCKETS


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, those of about ``PART`` bytes at a time."""
    clean, at = text.translate(WORD_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + PART) if len(clean) - at > PART else -1
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def bucket_counts(text: bytes, grams: int = GRAMS) -> tuple[int, np.ndarray]:
    """(words, count of each bucket) of a whole text; runs of words reach over its parts."""
    total, counts, before = 0, np.zeros(BUCKETS, np.int64), []
    for words in word_parts(text):
        found = feature_buckets(before + words, grams, len(before))
        counts += np.bincount(found, minlength=BUCKETS)
        total += len(words)
        before = (before + words)[-(grams - 1):] if grams > 1 else []
    return total, counts


def planes(values: np.ndarray) -> np.ndarray:
    """Bits of non-negative numbers: (number of planes, 64-bit words), the lowest plane first."""
    most = int(values.max(initial=0))
    top = most.bit_length()
    small = values.astype(np.min_scalar_type(most))
    bits = (small[None, :] >> np.arange(top, dtype=small.dtype)[:, None]) & 1
    padded = np.zeros((top, -(-len(values) // 64) * 64), np.uint8)
    padded[:, :len(values)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Gains:
    """Bit planes of the positive and of the negative gains, with the power of two of each."""

    def __init__(self, gains: np.ndarray) -> None:
        up, down = planes(np.maximum(gains, 0)), planes(np.maximum(-gains, 0))
        self.planes = np.concatenate([up, down])
        self.powers = np.concatenate([1 << np.arange(len(up)), -(1 << np.arange(len(down)))])

    def weight(self, counts: np.ndarray) -> int:
        """Sum of gain times count, exact."""
        total = 0
        for j, plane in enumerate(planes(counts)):
            shared = np.bitwise_count(plane[None, :] & self.planes).sum(axis=1, dtype=np.int64)
            total += int(shared @ self.powers) << j
        return total


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column).cast(pa.large_binary()):
        yield text.as_py() or b""


def corpus_counts(docs: DataFrame, text: str = "text", grams: int = GRAMS) -> np.ndarray:
    """Features of all texts by bucket; a task sends one row per bucket it met."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for body in _texts(batch, 0):
                total += bucket_counts(body, grams)[1]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled, floored logarithm of the ratio of the smoothed shares of each bucket."""
    whole, aim = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([
        math.floor(scale * math.log(((t + 1) * whole) / ((s + 1) * aim)))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], np.int64)


def noise(doc_id: str = "doc_id", seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled, floored Gumbel noise from the id; a null id has that of the word ``null``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", grams: int = GRAMS) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight) of every row."""
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = Gains(gain)
        for batch in batches:
            rows = []
            for body in _texts(batch, 2):
                n, counts = bucket_counts(body, grams)
                rows.append((n, int(counts.sum()), sliced.weight(counts)))
            made = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, made)],
                names=["doc_id", "text_key", "n_words", "n_features", "weight"],
            )

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(weighed, "doc_id long, text_key long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; null and empty
    texts have none, weight 0, and are never drawn. Of the N rows with ``least_words`` words or more
    the ``percent * N // 100`` with the highest scores are drawn: their rank counts from 1, ties go to
    the smaller id (null ids last, then by ``text_key``; equal rows in any order), all other ranks are
    null. Repeated rows are rows of their own. Empty ``docs`` give no row; an empty target has no
    features, so that rare buckets gain. Other columns are ignored.
    """
    gain = gains(corpus_counts(docs, text), corpus_counts(target, target_text))
    scored = materialise(
        weights(docs, gain, doc_id, text).withColumn("score", F.col("weight") + noise(seed=seed)), "scores"
    )
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    keep = n * percent // 100
    # Only rows that can be drawn are ranked: a score below the last drawn one ends the search.
    floor = _floor(scored.where(able).select("score"), keep, n)
    may = able & (F.col("score") >= floor) if floor is not None else F.lit(False)
    ranked = _numbered(scored.where(may), keep)
    return ranked.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def _numbered(rows: DataFrame, keep: int) -> DataFrame:
    """``rows`` with their place by falling score in ``rank``, null beyond ``keep``.

    Rows are dealt by ranges of the order and numbered inside a range; what comes before a range is
    the sum of the sizes of the ranges before, one row each.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_key").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialise(placed.withColumn("__row", F.monotonically_increasing_id()), "candidates")
    part = F.shiftright("__row", 33)
    sizes = written.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("__part", (earlier - F.col("__first") + 1).alias("__shift"))
    place = F.col("__row") + F.col("__shift")
    joined = written.withColumn("__part", part).join(F.broadcast(shift), "__part")  # a row for each partition
    return joined.withColumn("rank", F.when(place <= keep, place)).drop("__part", "__row", "__shift")


def _floor(scores: DataFrame, keep: int, n: int) -> int | None:
    """A score that at least ``keep`` rows reach, and not many more: from the quantile sketch of
    Spark, whose error is one in 10,000 of the rows; checked by a count."""
    if not keep:
        return None
    share = 1 - keep / n
    for slack in (0.0002, 0.002, 0.02):
        floor = scores.agg(F.percentile_approx("score", max(0.0, share - slack), 10_000)).first()[0]
        if scores.where(F.col("score") >= floor).count() >= keep:
            return floor
    return scores.agg(F.min("score")).first()[0]


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` (doc_id, text, ...) with their columns. Rows that repeat one another
    are drawn together: as many as exist, once one of them is."""
    chosen = resample(docs, target, percent=percent, least_words=least_words, seed=seed).where("rank is not null")
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumn("__text_key", text_key("text"))
    same = keyed.doc_id.eqNullSafe(chosen["__id"]) & (keyed["__text_key"] == chosen["__key"])
    return keyed.join(chosen, same, "left_semi").drop("__text_key")
