"""Exact substring dedup with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus. Every
window of that length is named by the smallest hash of the short strings inside it, so equal
windows have equal names wherever they stand. Neighbouring windows of one name make a run. Runs
whose name occurs once hold nothing repeated. The others are sorted into shards by name; a shard
builds the suffix array of its distinct runs (Larsson-Sadakane refinement), their common prefixes
(Kasai), and finds the windows that start earlier. A name with too many bytes for a shard is dealt
to several, whose sorted windows are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlab.llm.common import text_key
from threadlab.session import discard, materialise

LENGTH = 100
GRAM = 32  # bytes hashed for a window's name
LONGEST = 512  # windows of a run; longer ones are cut
SHARD = 400_000  # bytes a suffix array is built over, about
MERGE = 2_000  # windows that are merged at once, about
JOINED = 1 << 17  # bytes of documents that are named at once: arrays that stay in the cache


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def names(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each string of ``gram`` bytes, and the name of each window: its smallest hash."""
    h = BYTES[data]
    size = 1
    while size < gram:  # hash of twice as many bytes from two neighbours
        factor = np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64))
        h = h[:-size] * factor + h[size:]
        size *= 2
    hashes = _mixed(h)
    return hashes, _sliding(np.minimum, hashes, length - gram + 1)


def _sliding(extreme: np.ufunc, values: np.ndarray, wide: int) -> np.ndarray:
    """Smallest or largest of every ``wide`` neighbours."""
    h, span = values, 1
    while 2 * span <= wide:
        h = extreme(h[:-span], h[span:])
        span *= 2
    return extreme(h[:len(h) - (wide - span)], h[wide - span:])


def _places(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) for every place of the ranges."""
    nth = np.repeat(np.arange(len(count)), count)
    return nth, np.arange(len(nth)) + np.repeat(start - (np.cumsum(count) - count), count)


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first byte, windows, name, whether the naming string occurs again inside) of
    each run of windows with one name."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(bool)
    hashes, name = names(data, length)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(name)]
    at = np.arange(len(name))
    inside = ends[owner] - at >= length
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    breaks = np.flatnonzero(new | ~inside)
    stops = np.append(breaks[1:], len(name))
    real = inside[breaks]
    first, count = breaks[real], (stops - breaks)[real]
    which, part = _places(np.zeros(len(count), np.int64), -(-count // LONGEST))
    start = first[which] + part * LONGEST
    count = np.minimum(count[which] - part * LONGEST, LONGEST)
    # Only strings that name a window can be a run's naming string: a few in a hundred.
    beyond = np.zeros(length - GRAM, np.uint64)
    naming = np.flatnonzero(_sliding(np.maximum, np.concatenate([beyond, name, beyond]), length - GRAM + 1) == hashes)
    low = np.searchsorted(naming, start)
    nth, place = _places(low, np.searchsorted(naming, start + count + (length - GRAM)) - low)
    again = np.bincount(nth[hashes[naming[place]] == name[start][nth]], minlength=len(start)) > 1
    who = owner[start]
    return who, start - (ends - sizes)[who], count, name[start].view(np.int64), again


def _portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[int], list[bytes], pa.RecordBatch]]:
    """Row numbers and UTF-8 texts, some at a time."""
    for batch in batches:
        rows, texts, total = [], [], 0
        for i, value in enumerate(batch.column(column)):
            text = (value.as_py() or "").encode("utf-8")
            rows.append(i)
            texts.append(text)
            total += len(text)
            if total >= JOINED:
                yield rows, texts, batch
                rows, texts, total = [], [], 0
        if rows:
            yield rows, texts, batch


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of texts laid end to end; ``ends``: where each position's text ends.

    Larsson-Sadakane: ranks by the first seven bytes, then by twice as many in each round; only
    places whose group of equal ranks is unsorted are sorted again. An end comes before any byte;
    suffixes equal up to their ends are in order of place.
    """
    n, width = len(data), 7
    at = np.arange(n)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(width, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(width):  # nine bits each: 0 is beyond the end
        key = (key << np.uint64(9)) | np.where(at + k < ends, padded[k:n + k], np.uint64(0))
    order = np.argsort(key)
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while True:
        open_ = open_[order[open_] + width <= ends[order[open_]]]  # the others are equal up to their ends
        if not len(open_):
            break
        own = order[open_]
        after = own + width
        key = (rank[own] << 32) | np.where(after < ends[own], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[open_] = own
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(own)))
        rank[own] = np.repeat(open_[begin], size)
        open_ = open_[np.repeat(size > 1, size)]
        width *= 2
    ranked = rank[order]
    tied = np.flatnonzero(np.concatenate([[False], ranked[1:] == ranked[:-1]]) | np.append(ranked[1:] == ranked[:-1], False))
    order[tied] = np.sort((ranked[tied] << 32) | order[tied]) & 0xFFFFFFFF
    return order


def kasai(
    data: np.ndarray, ends: np.ndarray, before: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int = LENGTH
) -> np.ndarray:
    """Common prefix, up to ``length``, of each suffix with the one ``before`` it in the suffix array
    (-1: none). A suffix has at least the prefix of its left neighbour less one; all texts (first
    position, number of positions to look at) advance together."""
    common = np.zeros(len(data), np.int64)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    held = np.zeros(len(starts), np.int64)
    for t in range(int(counts[0]) if len(counts) else 0):
        n = int(np.searchsorted(-counts, -t, side="left"))  # texts with more than t positions
        i = starts[:n] + t
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(held[:n] - 1, 0))
        most = np.where(j < 0, 0, np.minimum(np.minimum(ends[i] - i, ends[j] - j), length))
        live = np.flatnonzero(h < most)
        while len(live):
            live = live[data[i[live] + h[live]] == data[j[live] + h[live]]]
            h[live] += 1
            live = live[h[live] < most[live]]
        held[:n] = h
        common[i] = h
    return common


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts in order of place: (whether each position's window stands earlier, the suffix array
    of windows, first position of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    order = suffix_array(data, ends)
    before = np.full(len(data), -1)
    before[order[1:]] = order[:-1]
    common = kasai(data, ends, before, stops - sizes, sizes - length + 1, length)
    order = order[ends[order] - order >= length]  # suffixes with equal windows stay side by side
    begin = np.flatnonzero((common[order] < length) | (np.arange(len(order)) == 0))
    first = np.minimum.reduceat(order, begin) if len(begin) else order
    later = np.zeros(len(data), bool)
    later[order] = order != np.repeat(first, np.diff(np.append(begin, len(order))))
    return later, order, stops - sizes


def _spans(later: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges covered by the marked windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], later.view(np.int8), [0]])))
    return edge[::2], edge[1::2] + length - 1


PLACE = ["none", "doc_id", "text_key", "start"]
RUNS = pa.schema([
    ("name", pa.int64()), ("digest", pa.binary()), ("none", pa.bool_()), ("doc_id", pa.int64()),
    ("text_key", pa.int64()), ("start", pa.int64()), ("again", pa.bool_()), ("run", pa.binary()),
])
RUN_ROWS = "name long, digest binary, none boolean, doc_id long, text_key long, start long, again boolean, run binary"
SPAN_ROWS = "doc_id long, text_key long, begin long, stop long"
WINDOW_ROWS = SPAN_ROWS + ", window binary, none boolean"


NAMED_ROWS = "row long, doc_id long, text_key long, names array<long>, places array<long>"


def named_runs(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, names, places): one row per text long enough, with the names of its runs
    and where they are: first byte, windows less one in nine bits, whether it may repeat itself in one."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, texts, batch in _portions(batches, 3):
            who, start, count, name, again = runs(texts)
            offsets = pa.array(np.searchsorted(who, np.arange(len(texts) + 1)).astype(np.int32))
            lists = (pa.array(name), pa.array(start << 10 | (count - 1) << 1 | again))
            keys = batch.select([0, 1, 2]).take(pa.array(numbers))
            yield pa.RecordBatch.from_arrays(
                [*keys.columns, *(pa.ListArray.from_arrays(offsets, x) for x in lists)],
                names=["row", "doc_id", "text_key", "names", "places"],
            )

    long = rows.where(F.octet_length("text") >= LENGTH).withColumn("row", F.monotonically_increasing_id())
    return long.select("row", "doc_id", "text_key", "text").mapInArrow(named, NAMED_ROWS)


def _exploded(named: DataFrame) -> DataFrame:
    """(row, name, place): a row per run."""
    return named.select("row", F.inline(F.arrays_zip("names", "places"))).toDF("row", "name", "place")


def suspect_runs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The runs (``RUN_ROWS``) at the ``runs`` (name, place) of their text."""
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in RUNS]
            columns = (batch.column(i) for i in range(4))
            for text, doc, key, found in zip(*columns, strict=True):
                data, doc, key = text.as_py().encode("utf-8"), doc.as_py(), key.as_py()
                values = found.values
                for name, place in zip(values.field(0).to_pylist(), values.field(1).to_pylist(), strict=True):
                    start = place >> 10
                    run = data[start:start + ((place >> 1) & 511) + LENGTH]
                    row = (name, xxhash.xxh3_128_digest(run), doc is None, doc, key, start, bool(place & 1), run)
                    for column, value in zip(made, row, strict=True):
                        column.append(value)
                if len(made[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, RUNS, strict=True)], schema=RUNS)
                    made = [[] for _ in RUNS]
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, RUNS, strict=True)], schema=RUNS)

    same = rows.doc_id.eqNullSafe(wanted["__id"]) & (rows.text_key == wanted["__key"])
    return rows.join(wanted, same).select("text", "doc_id", "text_key", "runs").mapInArrow(taken, RUN_ROWS)


def _shard(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    part = part.sort_values(PLACE, kind="stable").reset_index(drop=True)
    later, order, first = repeated_windows(part["run"].tolist())
    return part, later, order, first


def _located(part: pd.DataFrame, first: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pd.DataFrame:
    who = np.searchsorted(first, begin, side="right") - 1
    moved = part["start"].to_numpy()[who] - first[who]
    return pd.DataFrame({
        "doc_id": part["doc_id"].to_numpy()[who], "text_key": part["text_key"].to_numpy()[who],
        "begin": begin + moved, "stop": stop + moved, "none": part["none"].to_numpy()[who],
    })


def shard_spans(part: pd.DataFrame) -> pd.DataFrame:
    """Byte ranges of a shard's runs whose windows start earlier in the shard."""
    part, later, _, first = _shard(part)
    return _located(part, first, *_spans(later, LENGTH)).drop(columns="none")


def shard_windows(part: pd.DataFrame) -> pd.DataFrame:
    """The windows of a shard: in sorted order the first of each, with its bytes; then the ranges
    of all others, which need no merging."""
    part, later, order, first = _shard(part)
    data = b"".join(part["run"])
    kept = order[~later[order]]
    own = _located(part, first, kept, kept + LENGTH)
    own["window"] = [data[i:i + LENGTH] for i in kept.tolist()]
    rest = _located(part, first, *_spans(later, LENGTH))
    rest["window"] = None
    return pd.concat([own, rest], ignore_index=True)[[c.split()[0] for c in WINDOW_ROWS.split(", ")]]


def merge_windows(part: pd.DataFrame) -> pd.DataFrame:
    """Windows of several shards in order of place: each is looked up among the sorted distinct
    windows; all but the first of its kind are returned."""
    part = part.sort_values(["none", "doc_id", "text_key", "begin"], kind="stable")
    windows = np.array([w + b"\x01" for w in part["window"]])  # the mark keeps trailing zero bytes
    distinct = np.unique(windows)
    at = np.searchsorted(distinct, windows)
    seen = np.full(len(distinct), len(windows))
    np.minimum.at(seen, at, np.arange(len(windows)))
    return part[seen[at] != np.arange(len(windows))][["doc_id", "text_key", "begin", "stop"]]


def repeated_spans(docs: DataFrame, shard: int = SHARD, merge: int = MERGE) -> DataFrame:
    """(doc_id, text_key, spans): byte ranges to remove, unsorted, for documents that have any."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), "text"
    )
    # Hashed once: counted, joined and cut from this table.
    named = materialise(named_runs(rows), "named-runs")
    each = _exploded(named)
    repeated = materialise(
        each.groupBy("name").agg(F.count("*").alias("n"), F.bit_or(F.col("place").bitwiseAND(1)).alias("again"))
        .where("n > 1 or again > 0").select("name"),
        "repeated-names",
    )
    suspects = each.join(repeated, "name").groupBy("row").agg(F.collect_list(F.struct("name", "place")).alias("runs"))
    # Of repeated rows of a text one says where its runs are.
    texts = named.groupBy("doc_id", "text_key").agg(F.min("row").alias("row"))
    wanted = suspects.join(texts, "row").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "runs")
    found = materialise(suspect_runs(rows, wanted), "suspect-runs")
    discard(named)

    place = F.struct(*PLACE)
    distinct = materialise(
        found.groupBy("name", "digest").agg(F.min(F.struct(*PLACE, "again", "run")).alias("first"))
        .select("name", "digest", "first.*"),
        "distinct-runs",
    )
    # All holders of a run but the first lose it whole.
    firsts = distinct.select("name", "digest", F.struct(*PLACE).alias("first"))
    copies = (
        found.select("name", "digest", *PLACE, F.octet_length("run").alias("size"))
        .join(firsts, ["name", "digest"]).where(place != F.col("first"))
        .select("doc_id", "text_key", F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("stop"))
    )
    # A run that is alone under its name and holds its naming string once repeats nothing.
    shared = materialise(
        distinct.groupBy("name")
        .agg(F.sum(F.octet_length("run")).alias("bytes"), F.count("*").alias("n"), F.bool_or("again").alias("again"))
        .where("n > 1 or again").select("name", "bytes", F.ceil(F.col("bytes") / shard).alias("shards")),
        "shared-names",
    )
    shards = max(1, ceil((shared.agg(F.sum("bytes")).first()[0] or 0) / shard))
    light = distinct.join(shared.where("shards = 1").select("name"), "name")
    spans = (
        light.select(F.pmod(F.xxhash64("name"), F.lit(shards)).alias("shard"), *PLACE, "run")
        .groupBy("shard").applyInPandas(shard_spans, SPAN_ROWS)
    )
    dealt = distinct.join(shared.where("shards > 1").select("name", "shards"), "name").select(
        F.xxhash64("name", F.pmod(F.xxhash64("digest"), F.col("shards"))).alias("shard"), *PLACE, "run"
    )
    windows = materialise(dealt.groupBy("shard").applyInPandas(shard_windows, WINDOW_ROWS), "shard-windows")
    open_ = windows.where("window is not null")
    groups = max(1, ceil(open_.count() / merge))
    merged = (
        open_.withColumn("bucket", F.pmod(F.xxhash64("window"), F.lit(groups)))
        .groupBy("bucket").applyInPandas(merge_windows, SPAN_ROWS)
    )
    settled = windows.where("window is null").select("doc_id", "text_key", "begin", "stop")
    every = copies.unionByName(spans).unionByName(merged).unionByName(settled)
    return materialise(
        every.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "stop")).alias("spans")), "spans"
    )


def kept_bytes(text: str | None, spans: list | None) -> tuple[bytes, int, int, int]:
    """(remaining bytes, bytes, removed bytes, maximal removed ranges) of a text."""
    data = (text or "").encode("utf-8")
    out, at, removed, count, open_to = [], 0, 0, 0, -1
    for begin, stop in sorted((s["begin"], s["stop"]) for s in (spans if spans is not None else ())):
        if begin > open_to:
            count += 1
        if stop > at:
            out.append(data[at:max(at, begin)])
            removed += stop - max(at, begin)
            at = stop
        open_to = max(open_to, stop)
    out.append(data[at:])
    return b"".join(out), len(data), removed, count


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def with_spans(docs: DataFrame, shard: int = SHARD, merge: int = MERGE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``spans`` (begin, stop), null if nothing is repeated.

    Positions are bytes of the UTF-8 text, null is empty. Documents are ordered by id, null ids
    last, then by ``text_key``; repeated rows are one document and get the same spans.
    """
    spans = repeated_spans(docs, shard, merge).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans"
    )
    keyed = docs.withColumn("__text_key", text_key("text"))
    same = keyed.doc_id.eqNullSafe(spans["__id"]) & (keyed["__text_key"] == spans["__key"])
    return keyed.join(spans, same, "left").drop("__id", "__key", "__text_key")


def removal_digests(docs: DataFrame, shard: int = SHARD, merge: int = MERGE) -> DataFrame:
    """Per document: bytes, removed bytes, removed ranges and the SHA-256 of what remains."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for doc, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
                kept, size, removed, count = kept_bytes(text.as_py(), spans.as_py())
                made.append((doc.as_py(), size, removed, count, hashlib.sha256(kept).hexdigest()))
            if made:
                columns = list(zip(*made, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=[c.split()[0] for c in DIGESTS.split(", ")],
                )

    marked = with_spans(docs.select("doc_id", "text"), shard, merge)
    return marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(digest, DIGESTS)
