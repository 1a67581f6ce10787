"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 r`` bits have a value in common that is at most ``r``
bits away from both. So every distinct fingerprint stands for all its variants within ``r`` bits,
and fingerprints that share a variant are linked. A variant is dealt out by its leading bits: a
fingerprint is sent once to each leading value its variants have, and the task that owns that
value makes just those variants. All variants meet, while the shuffle carries some dozens of rows
per fingerprint instead of some thousands.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from threadlab.llm.common import text_key
from threadlab.llm.graph import components
from threadlab.session import materialise

SHINGLE = 4
DISTANCE = 4
SEED = 42
BUCKET = 2_000_000  # variants a bucket holds on average
BATCH = 4_000_000  # variants made at once inside a bucket


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over XXH64 of the word shingles, repeats included; signed; no word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[i:j], SEED) for i, j in zip((ends - lengths)[:n].tolist(), ends[shingle - 1:].tolist())],
            np.uint64,
        )
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    @F.pandas_udf(LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn("fingerprint", prints(text))


def _masks(bits: int, flips: int) -> np.ndarray:
    """All values of ``bits`` bits with exactly ``flips`` bits set."""
    return np.array(
        [sum(1 << b for b in chosen) for chosen in combinations(range(bits), flips)], np.uint64
    ).reshape(-1)


def _collisions(
    value: np.ndarray, owner: np.ndarray, left: np.ndarray, low: int, batch: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners that share a variant. value: leading bits as in the bucket, ``left`` flips still
    free in the ``low`` last bits. Too many variants at once: halve by the next bit."""
    if len(value) < 2:
        return
    sizes = np.array([sum(comb(low, f) for f in range(r + 1)) for r in range(int(left.max()) + 1)])
    if sizes[left].sum() > batch and low:
        bit = np.uint64(1 << (low - 1))
        for side in (np.uint64(0), bit):
            flip = (value & bit) != side
            stay = left >= flip
            rest = left[stay] - flip[stay]
            fixed = np.where(flip, value ^ bit, value)[stay]
            yield from _collisions(fixed, owner[stay], rest, low - 1, batch)
        return
    made, made_by = [], []
    for flips in range(int(left.max()) + 1):
        able = left >= flips
        masks = _masks(low, flips)
        if len(masks) and able.any():
            made.append((value[able][:, None] ^ masks[None, :]).ravel())
            made_by.append(np.repeat(owner[able], len(masks)))
    variants, by = np.concatenate(made), np.concatenate(made_by)
    order = np.argsort(variants)
    variants, by = variants[order], by[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    if len(same):
        a, b = by[same], by[same + 1]
        keys = np.unique(np.minimum(a, b).astype(np.int64) << 32 | np.maximum(a, b))
        yield keys >> 32, keys & 0xFFFFFFFF


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest node it is tied to."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_links(prints: np.ndarray, bucket: int, bits: int, distance: int, batch: int = BATCH) -> np.ndarray:
    """Pairs (n, 2) that tie together the fingerprints sharing a variant of this bucket."""
    prints = np.unique(prints.astype(np.int64)).view(np.uint64)
    low = 64 - bits
    top = np.uint64(bucket << low)
    apart = np.bitwise_count((prints ^ top) >> np.uint64(low)) if bits else np.zeros(len(prints), np.uint8)
    left = distance // 2 - apart.astype(np.int64)
    near = left >= 0
    prints, left = prints[near], left[near]
    value = (prints & np.uint64((1 << low) - 1)) | top
    owner = np.arange(len(prints), dtype=np.int64)
    label = owner
    for a, b in _collisions(value, owner, left, low, batch):
        close = np.bitwise_count(prints[a] ^ prints[b]) <= distance  # a shared variant implies it
        a, b = a[close], b[close]
        tied = np.flatnonzero(label != owner)
        label = _forest(len(prints), np.concatenate([a, tied]), np.concatenate([b, label[tied]]))
    tied = np.flatnonzero(label != owner)
    return np.stack([prints[label[tied]], prints[tied]], axis=1).view(np.int64)


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (column ``fingerprint``) -> links (a, b) with the same connectivity
    as all pairs at ``distance`` or fewer bits. ``distance`` is even: half of it is the radius."""
    radius = distance // 2
    ball = sum(comb(64, f) for f in range(radius + 1))
    bits = min(32, max(6, ceil(log2(max(2, prints.count() * ball / bucket)))))
    masks = [int(m) for f in range(radius + 1) for m in _masks(bits, f)]
    head = F.shiftrightunsigned("fingerprint", 64 - bits)
    sent = prints.select(
        F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: head.bitwiseXOR(m))).alias("bucket"),
        "fingerprint",
    )

    def tie(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pairs = bucket_links(part["fingerprint"].to_numpy(), int(key[0]), bits, distance)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return sent.groupBy("bucket").applyInPandas(tie, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (long), ``component_id`` (smallest id reachable by
    links of at most ``distance`` bits) and ``representative`` (one row per component, repeated
    rows counted once).

    Null and empty texts have fingerprint zero, linked like any other. Null ids come after all
    others: a component of nothing but null ids has a null ``component_id``. Repeated rows give
    repeated results; an empty table gives no row; other columns are ignored. ``text_key`` names
    the row's text.
    """
    prints = materialise(
        with_fingerprint(
            docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle
        ).select("doc_id", text_key("text").alias("text_key"), "fingerprint"),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    own = materialise(prints.groupBy("fingerprint").agg(first), "distinct-fingerprints")
    groups = components(links(own, distance))
    marked = own.join(groups, own.fingerprint == groups.node, "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    # Written first, so that a join on a large component can be split.
    lowest = materialise(marked.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    member = materialise(
        marked.join(lowest, "component").select("fingerprint", "lowest"), "fingerprint-components"
    )
    return prints.join(member, "fingerprint").select(
        "doc_id",
        "text_key",
        "fingerprint",
        F.col("lowest.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("text_key") == F.col("lowest.text_key"))).alias(
            "representative"
        ),
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, columns as they were."""
    kept = (
        near_duplicates(docs, shingle=shingle, distance=distance)
        .where("representative")
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        .distinct()
    )
    keyed = docs.withColumn("__text_key", text_key("text"))
    same = keyed.doc_id.eqNullSafe(kept["__id"]) & (keyed["__text_key"] == kept["__key"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")
