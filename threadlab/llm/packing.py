"""Hierarchical multi-length packing of tokenised documents.

Documents are cut into whole windows of the longest context and a rest. A rest goes to the smallest
context tier that holds it; windows are made from the longest rests down, their gaps filled with
the rests of shorter tiers (best fit, then one cut to close the gap). Windows are dealt to step
groups of about equal token counts. Each task packs the documents it reads, block by block, so
nothing is shuffled and memory does not grow with the input.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (128, 256, 512, 1024, 2048)
SLACK = 4  # tokens the longest window may lack
STEP_TOKENS = 64 * 2048
BLOCK_TOKENS = 2_000_000
END_ID = 1
CACHE = 300_000

# The split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)
ARROW = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])


def _byte_chars() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary: itself, or from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def special_strings(path: str) -> regex.Pattern | None:
    """Matches the special tokens of a tokenizer file, in a group."""
    with open(path, encoding="utf-8") as file:
        found = [t["content"] for t in json.load(file).get("added_tokens", [])]
    return regex.compile("(" + "|".join(regex.escape(t) for t in sorted(found, key=len, reverse=True)) + ")") if found else None


def _long_blanks(text: str) -> bool:
    return len(text) >= LONG_BLANKS and any(m.end() - m.start() >= LONG_BLANKS for m in BLANKS.finditer(text))


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizer file; strings of special tokens are those tokens.

    A plain byte-level BPE whose ids follow its merges is run by tiktoken, which gives the same
    ids in a quarter of the time; any other file by tokenizers, and so are special tokens and long
    runs of white space, on which tiktoken's pattern overflows its stack.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    tokenizer = Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    plain = (
        model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not model.get("dropout") and not model.get("ignore_merges")
    )
    if plain:
        to_byte, vocab = _byte_chars(), model["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ordered = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        if ordered:
            import tiktoken

            ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}
            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            found = special_strings(path)

            def encode(text: str) -> list[int]:
                return slow(text) if _long_blanks(text) or found and found.search(text) else fast(text)

            return encode
    return slow


class Words(dict):
    """Id bytes of a word with its leading blank; emptied when full."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = array("I", self.encode(" " + word)).tobytes()
        self[word] = ids
        return ids


LONG_BLANKS = 20_000
BLANKS = regex.compile(r"\s++")
# The split pattern never joins a blank with what comes before it, unless it is inside white space.
INSIDE = regex.compile(r"\s (?:\s|\Z)")


def id_bytes(text: str, encode: Callable[[str], list[int]], words: Words, special: regex.Pattern | None = None) -> bytes:
    """Ids of a text as little-endian 32-bit words; what lies between special tokens is split by itself."""
    if special and special.search(text):
        parts = special.split(text)
        return b"".join(
            array("I", encode(part)).tobytes() if k % 2 else id_bytes(part, encode, words) for k, part in enumerate(parts) if part
        )
    if INSIDE.search(text):
        return array("I", encode(text)).tobytes()
    first, _, rest = text.partition(" ")
    out = array("I", encode(first)).tobytes()
    if len(first) < len(text):
        out += b"".join(map(words.__getitem__, rest.split(" ")))
    return out


class Packer:
    """Pieces are (length, serial, doc): doc is [doc_id, doc_tokens, start, id bytes]."""

    def __init__(self, tiers: tuple[int, ...], slack: int, step_tokens: int, base: int) -> None:
        self.tiers, self.slack, self.step_tokens = sorted(tiers), slack, step_tokens
        self.pool: list[tuple] = []
        self.windows: list[tuple[int, list[tuple]]] = []
        self.serial = 0
        self.sequence = self.step = base
        self.tokens = 0

    def put(self, doc_id: int | None, total: int, start: int, ids: bytes) -> None:
        self.serial += 1
        insort(self.pool, (len(ids) // 4, self.serial, (doc_id, total, start, ids)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        longest, total = self.tiers[-1], len(ids) // 4
        self.tokens += total
        whole = total - total % longest
        for start in range(0, whole, longest):
            piece = (longest, 0, (doc_id, total, start, ids[4 * start:4 * (start + longest)]))
            self.windows.append((longest, [piece]))
        if whole < total:
            self.put(doc_id, total, whole, ids[4 * whole:])

    def cut(self, at: int, length: int) -> tuple:
        """The first ``length`` tokens of pool piece ``at``; its rest goes back."""
        size, serial, (doc_id, total, start, ids) = self.pool.pop(at)
        if size > length:
            self.put(doc_id, total, start + length, ids[4 * length:])
        return (length, serial, (doc_id, total, start, ids[:4 * length]))

    def fill(self, pieces: list[tuple], gap: int, slack: int) -> int:
        while gap > slack and self.pool:
            at = bisect_right(self.pool, (gap, float("inf"))) - 1
            if at >= 0:
                pieces.append(self.pool.pop(at))
            else:
                pieces.append(self.cut(bisect_left(self.pool, (gap,)), gap))
            gap -= pieces[-1][0]
        return gap

    def pack(self, last: bool) -> None:
        """Windows from the longest rest down; what cannot close a window waits for the next block."""
        while self.pool:
            first = self.pool.pop()
            size = next(t for t in self.tiers if t >= first[0])
            slack = self.slack if size == self.tiers[-1] else 0
            pieces = [first]
            gap = self.fill(pieces, size - first[0], slack)
            if gap <= slack:
                self.windows.append((size, pieces))
                continue
            for length, serial, doc in pieces:  # the pool is empty: all that is left is less than a window
                insort(self.pool, (length, serial, doc))
            if not last:
                return
            left = size - gap
            size = max((t for t in self.tiers if t <= left), default=0)
            pieces = []
            if size:  # a smaller tier is filled exactly
                while (need := size - sum(p[0] for p in pieces)) > 0:
                    pieces.append(self.cut(len(self.pool) - 1, min(need, self.pool[-1][0])))
                self.windows.append((size, pieces))
            else:
                self.windows.append((self.tiers[-1], self.pool))
                self.pool = []

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        self.pack(last)
        self.tokens = sum(p[0] for p in self.pool)
        if not self.windows:
            return
        self.windows.sort(key=lambda w: -w[0])
        steps = max(1, round(sum(w[0] for w in self.windows) / self.step_tokens))
        load = [(0, self.step + i) for i in range(steps)]
        rows: list[list[int | None]] = [[] for _ in ARROW]
        for size, pieces in self.windows:  # the longest left goes to the lightest step
            taken, step = load[0]
            heapq.heapreplace(load, (taken + size, step))
            offset = 0
            for length, _, (doc_id, total, start, ids) in pieces:
                row = (doc_id, start, length, zlib.crc32(ids), total, self.sequence, offset, size, step)
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
                offset += length
            self.sequence += 1
        self.step += steps
        self.windows = []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=ARROW)


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    slack: int = SLACK,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece of a document: where it starts, its length and the CRC-32 of its ids, the
    sequence and offset it lies at, that sequence's context tier and step group.

    ``tokenizer`` is a file all executors can open. Strings of its special tokens in a text are those
    tokens. An end id closes each document, so null and empty texts are one token long; texts of any
    length and kind are cut into as many pieces as they need. Ties keep the order of reading; repeated rows and null ids are
    documents of their own. Sequences are full, but for ``slack`` tokens in the longest tier and
    one sequence per task. Sequence and step numbers hold the task's number in the upper half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special = encoder(tokenizer), special_strings(tokenizer)
        words = Words(encode)
        end = array("I", [END_ID]).tobytes()
        packer = Packer(tiers, slack, step_tokens, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(key, id_bytes(body.as_py() or "", encode, words, special) + end)
                if packer.tokens >= block_tokens:
                    yield from packer.flush()
        yield from packer.flush(last=True)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
