"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds: hashes of runs of words. Pairs with enough shared
seeds are tiled: the longest common runs of unmarked words are marked in both, again and again,
down to the length of a seed, found with running Karp-Rabin hashes. The share of an item's words
under tiles is its coverage; the order of the tiles does not matter, so reordered passages count like
others. Before the join, a bit table of bounded size tells which runs of a document can be seeds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlab.llm.common import text_key
from threadlab.session import materialise

LEAST = 5  # words of the shortest tile
COVERAGE = 0.5
LINE_WORDS = 2  # items with so many words or fewer match whole lines only
MOST_BITS = 27  # the bit table has two to this power at most: 16 MB
CHUNK = 1 << 16  # bytes of the table that are put together at once
CACHE = 300_000
BASE = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, text_key long, item_id long, n_tiles long, n_matched long, n_item_words long, coverage double"
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Hashes(dict):
    """64-bit hash of a word, never 0."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word) | 1
        return made


def word_hashes(text: str | None, known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of a text, line number of each)."""
    lines = [WORD.findall(line) for line in (text or "").lower().split("\n")]
    sizes = [len(x) for x in lines]
    flat = np.fromiter((known[w] for line in lines for w in line), np.uint64, sum(sizes))
    return flat, np.repeat(np.arange(len(lines)), sizes)


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(steps)


def windows(ids: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Karp-Rabin hash of each run of ``length`` ids."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers.reach(len(ids))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers.up[:len(ids)], dtype=np.uint64)])
    return (sums[length:] - sums[:n]) * powers.down[:n]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    taken = np.concatenate([[0], np.cumsum(marked)])
    return taken[length:] == taken[:-length]


def _common(item: np.ndarray, doc: np.ndarray, in_item: np.ndarray, in_doc: np.ndarray, length: int, powers: Powers):
    """(places in item, their hashes, places in doc, their hashes) of unmarked runs whose hash both have."""
    if length > min(len(item), len(doc)):
        return None
    a, b = windows(item, length, powers), windows(doc, length, powers)
    i, j = np.flatnonzero(_free(in_item, length)), np.flatnonzero(_free(in_doc, length))
    shared = np.intersect1d(a[i], b[j])
    if not len(shared):
        return None
    i, j = i[np.isin(a[i], shared)], j[np.isin(b[j], shared)]
    return i, a[i], j, b[j]


def tiles(item: np.ndarray, doc: np.ndarray, least: int, powers: Powers) -> list[tuple[int, int, int]]:
    """Greedy tiling of two hash arrays: (place in item, place in doc, length).

    Each round finds the length of the longest common unmarked run, by doubling and halving, and marks
    all runs of that length that do not overlap, the first in the item with the first in the
    document. No pairs of places are listed, so repeated words cost no more than others.
    """
    out: list[tuple[int, int, int]] = []
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    while True:
        low, found = least, _common(item, doc, in_item, in_doc, least, powers)
        if found is None:
            return out
        high = 2 * least
        while (more := _common(item, doc, in_item, in_doc, high, powers)) is not None:
            low, found, high = high, more, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            more = _common(item, doc, in_item, in_doc, mid, powers)
            if more is None:
                high = mid
            else:
                low, found = mid, more
        places, own, theirs, hashes = found
        order = np.argsort(hashes, kind="stable")
        theirs, hashes = theirs[order], hashes[order]
        begin, end = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
        following: dict[int, int] = {}  # by hash: the next place in the document to look at
        marked = False
        for i, h, a, b in zip(places.tolist(), own.tolist(), begin.tolist(), end.tolist(), strict=True):
            if in_item[i] or in_item[i + low - 1]:
                continue
            k = following.get(h, a)
            while k < b:
                j = int(theirs[k])
                k += 1
                if not (in_doc[j] or in_doc[j + low - 1]) and np.array_equal(item[i:i + low], doc[j:j + low]):
                    in_item[i:i + low] = in_doc[j:j + low] = marked = True
                    out.append((i, j, low))
                    break
            following[h] = k
        if not marked:  # hashes alone met
            return out


def _salted(hashes: np.ndarray, length: int, line: bool) -> np.ndarray:
    """Runs of different lengths, and whole lines, are different seeds."""
    return hashes ^ np.uint64((2 * length + line) * 0xD1B54A32D192ED03 % (1 << 64))


def item_seeds(item: np.ndarray, least: int, powers: Powers) -> np.ndarray:
    """Hash of each run of ``least`` words; of the whole of a shorter item."""
    n = len(item)
    if n >= least:
        return _salted(windows(item, least, powers), least, False)
    return _salted(windows(item, n, powers), n, n <= LINE_WORDS)


def document_seeds(doc: np.ndarray, line: np.ndarray, lengths: list[int], powers: Powers) -> tuple[np.ndarray, ...]:
    """(hashes, first words, numbers of words) of the runs of a document that can be an item's seed."""
    made = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for length in lengths:
        found = windows(doc, length, powers)
        at = np.arange(len(found))
        if length <= LINE_WORDS:
            begins = np.concatenate([[True], line[1:] != line[:-1]])[:len(found)]
            ends = np.concatenate([line[1:] != line[:-1], [True]])[length - 1:]
            at = np.flatnonzero(begins & ends & (line[:len(found)] == line[length - 1:]))
        made.append((_salted(found[at], length, length <= LINE_WORDS), at, np.full(len(at), length)))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


class SeedFilter:
    """Table of two bits for each seed: no seed is missed; few other runs pass, which the join drops."""

    def __init__(self, bits: int, table: np.ndarray | None = None) -> None:
        self.bits, self.table = bits, table

    def places(self, seeds: np.ndarray) -> list[np.ndarray]:
        factors = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
        return [((seeds * np.uint64(f)) >> np.uint64(64 - self.bits)).astype(np.int64) for f in factors]

    def __call__(self, seeds: np.ndarray) -> np.ndarray:
        one, other = ((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in self.places(seeds))
        return one & other


def seed_filter(seeds: DataFrame) -> SeedFilter:
    """The table of all rows of ``seeds``; its size follows their number up to ``MOST_BITS``."""
    out = SeedFilter(max(16, min(MOST_BITS, (512 * seeds.count()).bit_length())))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << out.bits, bool)
        for batch in batches:
            for at in out.places(batch.column(0).to_numpy().view(np.uint64)):
                flags[at] = True
        packed = np.packbits(flags, bitorder="little")
        chunks = [(i, packed[i:i + CHUNK]) for i in range(0, len(packed), CHUNK)]
        chunks = [(i, c.tobytes()) for i, c in chunks if c.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in chunks], pa.int64()), pa.array([c for _, c in chunks], pa.binary())], names=["at", "bits"]
        )

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"at": frame["at"][:1], "bits": [whole.tobytes()]})

    made = seeds.select("seed").mapInArrow(part, "at long, bits binary").groupBy("at").applyInPandas(together, "at long, bits binary")
    out.table = np.zeros((1 << out.bits) // 8, np.uint8)
    for row in made.collect():  # the table once: 2^MOST_BITS bits at most
        chunk = np.frombuffer(bytes(row.bits), np.uint8)
        out.table[row.at:row.at + len(chunk)] = chunk
    return out


def _rows(schema: str, made: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*made, strict=True) if made else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields]
    )


ITEM_ROWS = "item_id long, n_words long, words binary"
SEED_ROWS = "seed long, item_key long, n_words long, times long"
HIT_ROWS = "doc_id long, text_key long, seeds array<long>, region binary"


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for batch in batches:
        made = []
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            found, _ = word_hashes(text.as_py(), known)
            if len(found):
                made.append((key.as_py(), len(found), found.tobytes()))
        yield _rows(ITEM_ROWS, made)


def region_of(doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The words of a document under the runs, a word that matches nothing between them."""
    steps = np.zeros(len(doc) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length, -1)
    marked = np.cumsum(steps[:-1]) > 0
    kept = np.flatnonzero(marked)
    starts = marked & ~np.concatenate([[False], marked[:-1]])
    return np.insert(doc[kept], np.flatnonzero(starts[kept]), 0)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = LEAST,
    coverage: float = COVERAGE,
) -> DataFrame:
    """(doc_id, text_key, item_id, n_tiles, n_matched, n_item_words, coverage) of every document that
    covers an item.

    Words are runs of letters, digits and underscores, in lower case; they are compared by 64-bit
    hashes. An item with fewer than ``least`` words is covered where all its words stand in a row; one
    of ``LINE_WORDS`` words or fewer only where they are a whole line. Items and documents without a
    word (null and empty ones too) never match. Repeated items and documents give repeated rows, but
    equal items are looked for once; null ids are kept; other columns are ignored. Of a document only
    the words under possible seeds travel, whatever its length.
    """
    items = materialise(
        benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
        .mapInArrow(_item_words, ITEM_ROWS).withColumn("item_key", F.xxhash64("words")),
        "items",
    )
    texts = materialise(items.select("item_key", "n_words", "words").dropDuplicates(["item_key", "n_words"]), "item-texts")

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            made = []
            for key, n, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                found, times = np.unique(item_seeds(np.frombuffer(body.as_py(), np.uint64), least, powers), return_counts=True)
                made += zip(found.view(np.int64).tolist(), [key.as_py()] * len(found), [n.as_py()] * len(found), times.tolist(), strict=True)
            yield _rows(SEED_ROWS, made)

    seeds = materialise(texts.select("item_key", "n_words", "words").mapInArrow(seeded, SEED_ROWS), "item-seeds")
    lengths = sorted({min(r[0], least) for r in texts.select(F.least("n_words", F.lit(least))).distinct().collect()})
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))  # of bounded size

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers, may = Hashes(), Powers(), shared.value
        for batch in batches:
            made = []
            for key, own, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc, line = word_hashes(body.as_py(), known)
                hashes, at, length = document_seeds(doc, line, lengths, powers)
                passed = may(hashes)
                if passed.any():
                    region = region_of(doc, at[passed], length[passed])
                    made.append((key.as_py(), own.as_py(), np.unique(hashes[passed]).view(np.int64), region.tobytes()))
            if made:
                yield _rows(HIT_ROWS, made)

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("text")
    ).where("text is not null")
    hits = materialise(rows.mapInArrow(hit, HIT_ROWS).withColumn("row", F.monotonically_increasing_id()), "seeded-documents")
    enough = F.col("n") * least >= F.lit(coverage) * F.col("n_words")  # tiles are made of shared seeds
    pairs = (
        hits.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
        .groupBy("row", "item_key", "n_words").agg(F.sum("times").alias("n")).where(enough).select("row", "item_key", "n_words")
    )

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            made = []
            for values in zip(*(batch.column(i) for i in range(6)), strict=True):
                key, own, region, item_key, n, body = (v.as_py() for v in values)
                found = tiles(np.frombuffer(body, np.uint64), np.frombuffer(region, np.uint64), min(least, n), powers)
                matched = sum(t[2] for t in found)
                if matched >= coverage * n:
                    made.append((key, own, item_key, n, len(found), matched, matched / n))
            yield _rows(TILED_ROWS, made)

    both = pairs.join(hits.drop("seeds"), "row").join(texts, ["item_key", "n_words"])
    held = both.select("doc_id", "text_key", "region", "item_key", "n_words", "words").mapInArrow(tiled, TILED_ROWS)
    # Equal items share their tiles.
    return held.join(items.select("item_id", "item_key", "n_words"), ["item_key", "n_words"]).select(
        "doc_id", "text_key", "item_id", "n_tiles", "n_matched", F.col("n_words").alias("n_item_words"), "coverage"
    )


TILED_ROWS = "doc_id long, text_key long, item_key long, n_words long, n_tiles long, n_matched long, coverage double"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that cover a benchmark item; columns as they were."""
    bad = contaminated(docs, benchmark, least=least, coverage=coverage).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")
    ).distinct()
    keyed = docs.withColumn("__text_key", text_key("text"))
    same = keyed.doc_id.eqNullSafe(bad["__id"]) & (keyed["__text_key"] == bad["__key"])
    return keyed.join(bad, same, "left_anti").drop("__text_key")
