"""BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of a word. They are the exact ones if every token is what
merging makes of its own bytes, and every two neighbours are compatible: merging would not join
symbols across their border. Both are looked up by taking the later-made side of a border apart
again and again, for all borders of a batch at once. Only words with a clash are merged pair by pair.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

CACHE = 300_000  # distinct chunks whose ids are kept by a worker
BLOCK = 1 << 20  # bytes of text that are encoded at once
ROWS = 500  # texts that are decoded at once
SYMBOLS = 512  # bytes inside a word, then bytes that end one
LONG = 200  # symbols of a word that is merged by itself
SPACE = re.compile(r"\s")
# Kinds of the characters up to LATIN for the split pattern of the word vocabularies: white space,
# letters, numbers, others, and those that take the library's way (quotes begin contractions).
LATIN = 0x250
BLANK, LETTER, NUMBER, OTHER, ODD = range(5)


def _kind(c: str) -> int:
    if c == " ":
        return BLANK
    if c.isspace() and not "\x1c" <= c <= "\x1f" or c == "'" or len(c.lower()) > 1 or ord(c.lower()) >= LATIN:
        return ODD
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


KINDS = np.array([*(_kind(chr(c)) for c in range(LATIN)), ODD], np.int8)


def byte_chars() -> list[str]:
    """Printable stand-in of each byte in a byte-level vocabulary: itself, or from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Lookup:
    """Distinct keys of 0 or more to values, many at a time, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int) -> None:
        bits = max(4, (3 * len(keys)).bit_length())
        self.none, self.mask, self.shift = none, (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, none, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several one stays
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.none)
        left = np.flatnonzero((found != keys) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            found, wanted = self.keys[slot], keys[left]
            same = found == wanted
            out[left[same]] = self.values[slot[same]]
            on = ~same & (found >= 0)
            left, slot = left[on], slot[on]
        return out


class Decoder:
    """What decoding needs of a tokenizer file: the string of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        added = {t["content"]: t["id"] for t in self.spec.get("added_tokens", [])}
        vocab: dict[str, int] = self.spec["model"]["vocab"]
        self.strings = [""] * (max([*vocab.values(), *added.values()], default=-1) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            self.strings[i] = token
        self.decoder = self.spec.get("decoder")
        self.to_byte = {c: b for b, c in enumerate(byte_chars())}

    def decode(self, ids: list[int]) -> str:
        """Text of ids: with a byte-level decoder their bytes, without one their strings and blanks."""
        if self.decoder is None:
            return " ".join(map(self.strings.__getitem__, ids))
        if self.decoder["type"] != "ByteLevel":
            raise ValueError(f"no rule for decoder {self.decoder['type']}")
        known = "".join(map(self.strings.__getitem__, ids))
        return bytes(self.to_byte[c] for c in known).decode("utf-8", "replace")


class Tokenizer(Decoder):
    """A byte-level BPE file of the tokenizers library, with or without a mark for ends of words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer as Library

        super().__init__(path)
        spec = self.__dict__.pop("spec")
        model, library = spec["model"], Library.from_file(path)
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError(f"not a plain BPE file: {path}")
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.whole_first = bool(model.get("ignore_merges"))
        end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.size = len(self.strings)
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.special = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or b"(?!)")

        chars = byte_chars()
        self.marked = bool(end)
        self.base = np.array([vocab[c] for c in chars] + [vocab[c + end] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        n = len(pairs)
        self.none = n + 1  # rank of a pair that is never merged
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.full((2, self.size), -1, np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(n), left, right
        self.made = made
        self.pairs = Lookup(left * self.size + right, np.arange(n), self.none)
        self.merges = dict(zip(zip(left.tolist(), right.tolist()), zip(range(n), made.tolist())))
        # Borders can be judged alone only if each token has one merge, made of earlier tokens.
        born = self.rank
        self.sound = len(np.unique(made)) == n and bool((np.maximum(born[left], born[right]) < np.arange(n)).all())
        self._proper(made)
        self._trie()
        self.split_on_blanks = self._drops_blanks()
        self.as_words = self._splits_as_words()
        self.clear()

    # ---- speculation

    def _proper(self, made: np.ndarray) -> None:
        """Which tokens merging makes of their own bytes."""
        left, right = self.left[made], self.right[made]
        fits = (~self.clashes(left, right, parts=True)).tolist()
        proper = np.zeros(self.size, bool)
        proper[self.base] = True
        for token, a, b, ok in zip(made.tolist(), left.tolist(), right.tolist(), fits, strict=True):
            proper[token] = ok and proper[a] and proper[b]
        self.proper = proper

    def _symbols(self) -> dict[int, tuple[int, ...]]:
        spelled = {int(i): (s,) for s, i in reversed(list(enumerate(self.base.tolist())))}
        for token in np.argsort(self.rank, kind="stable").tolist():
            if self.rank[token] >= 0:
                spelled[token] = spelled[int(self.left[token])] + spelled[int(self.right[token])]
        return spelled

    def _trie(self) -> None:
        """Proper tokens as a tree: (node, symbol) -> child, and the token that ends at a node."""
        child: dict[int, int] = {}
        accept = [-1]
        for token, spelling in self._symbols().items():
            if not self.proper[token]:
                continue
            node = 0
            for s in spelling:
                node = child.setdefault(node * SYMBOLS + s, len(accept))
                if node == len(accept):
                    accept.append(-1)
            accept[node] = token
        self.child = Lookup(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)), -1)
        self.accept = np.array(accept, np.int64)

    def longest(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token from every place on, and its number of symbols; ``ends``: of each place's word."""
        token, size = np.full((2, len(symbols)), -1, np.int64)
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(at):
            node = self.child[node * SYMBOLS + symbols[at + depth]]
            known = node >= 0
            at, node = at[known], node[known]
            depth += 1
            ended = self.accept[node]
            hit = ended >= 0
            token[at[hit]], size[at[hit]] = ended[hit], depth
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
        return token, size

    # ---- verification

    def clashes(self, a: np.ndarray, b: np.ndarray, parts: bool = False) -> np.ndarray:
        """Whether merging the bytes of a and b would join symbols across their border.

        Seen backwards in time: of the two symbols at the border the one made later is taken apart.
        Symbols that meet are joined if their merge comes before each is used up; at equal ranks the
        one further left goes first. ``parts``: a and b are the parts of a token, whose own merge
        does not count.
        """
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full((2, len(a)), self.none - 1)
        first = parts
        while len(live):
            if not first:
                rank = self.pairs[a * self.size + b]
                clash = (rank < until_a) & (rank <= until_b)
                out[live[clash]] = True
            else:
                clash = np.zeros(len(live), bool)
            first = False
            born_a, born_b = self.rank[a], self.rank[b]
            go = ~clash & ((born_a >= 0) | (born_b >= 0))
            live, a, b, until_a, until_b, born_a, born_b = (
                x[go] for x in (live, a, b, until_a, until_b, born_a, born_b)
            )
            later = born_a > born_b
            until_a, until_b = np.where(later, born_a, until_a), np.where(later, until_b, born_b)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    # ---- exact merging

    def merge_all(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of many words after merging; ``ids`` are their bytes.

        A round joins, in every word, the pair of its lowest rank, at all places from the left.
        """
        word = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = sizes > LONG
        if long.any():
            stops = np.cumsum(sizes)
            for k in np.flatnonzero(long).tolist():
                own = self.merge(ids[stops[k] - sizes[k]:stops[k]].tolist())
                done.append((np.array(own, np.int64), np.full(len(own), k)))
            ids, word = ids[~long[word]], word[~long[word]]
        rank = self._ranks(ids, word)
        while len(ids):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(ids)))
            open_ = np.repeat(low < self.none, size)
            if not open_.all():
                done.append((ids[~open_], word[~open_]))
                ids, word, rank, low = ids[open_], word[open_], rank[open_], np.repeat(low, size)[open_]
                if not len(ids):
                    break
            else:
                low = np.repeat(low, size)
            at = np.flatnonzero(rank == low)
            new = np.concatenate([[True], np.diff(at) > 1])  # a run of places is one of equal symbols
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            touched = np.zeros(len(ids), bool)
            touched[at] = True
            ids, word, rank, touched = ids[stay], word[stay], rank[stay], touched[stay]
            touched[:-1] |= touched[1:]
            again = np.flatnonzero(touched)
            rank[again] = self._ranks(ids, word, again)
        ids, word = (np.concatenate([*(x[i] for x in done), np.zeros(0, np.int64)]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word.astype(np.int64), minlength=len(sizes))

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the pair that begins at each place (of ``at``); none at the end of a word."""
        at = np.arange(len(ids)) if at is None else at
        following = np.minimum(at + 1, len(ids) - 1)
        inside = (following > at) & (word[following] == word[at])
        out = np.full(len(at), self.none)
        out[inside] = self.pairs[ids[at[inside]] * self.size + ids[following[inside]]]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Ids after merging the pair of the lowest rank, the leftmost first, until none is left."""
        n, merges = len(ids), self.merges
        ids = [*ids, -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(*merges[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heap = [(rank, i) for rank, _, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            found = merges.get((ids[i], ids[j])) if ids[i] >= 0 and j < n else None
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (more := merges.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (more[0], k))
        return [t for t in ids if t >= 0]

    # ---- words and chunks

    def encode_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) for words of ``sizes`` bytes, none of them empty,
        end to end; ``failed`` counts those that were merged."""
        if not len(sizes):
            return np.zeros(0, np.int64), sizes
        stops = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        symbols = data.astype(np.int64)
        if self.marked:
            symbols[stops - 1] += 256
        token, size = self.longest(symbols, stops[owner])
        following, places, i, n = (np.arange(len(symbols)) + size).tolist(), [], 0, len(symbols)
        while i < n:  # from token to token, through all words
            places.append(i)
            i = following[i]
        at = np.array(places, np.int64)
        token, owner = token[at], owner[at]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(token[inner] * self.size + token[inner + 1], return_inverse=True)
        bad = self.clashes(pairs // self.size, pairs % self.size)
        failed = np.zeros(len(sizes), bool)
        failed[owner[inner[bad[which]]]] = True
        if not self.sound or self.whole_first:
            failed[:] = True
        counts = np.bincount(owner, minlength=len(sizes))
        self.failed, self.tried = self.failed + int(failed.sum()), self.tried + len(sizes)
        if not failed.any():
            return token, counts
        mine = failed[np.repeat(np.arange(len(sizes)), sizes)]
        merged, made = self.merge_all(self.base[symbols[mine]], sizes[failed])
        if self.whole_first:
            begin = stops - sizes
            words = [data[i:j].tobytes() for i, j in zip(begin[failed].tolist(), stops[failed].tolist(), strict=True)]
            merged, made = self._whole(words, merged, made)
        # Both kinds in the order of words.
        owners = np.concatenate([owner[~failed[owner]], np.repeat(np.flatnonzero(failed), made)])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([token[~failed[owner]], merged])[order], np.bincount(owners, minlength=len(sizes))

    def _whole(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are tokens as they stand, where the file says that those come first."""
        chars, stops = byte_chars(), np.cumsum(sizes)
        known = {t: i for i, t in enumerate(self.strings)}
        own = [known.get("".join(chars[b] for b in w)) for w in words]
        parts = [ids[e - n:e] if i is None else np.array([i]) for i, e, n in zip(own, stops, sizes, strict=True)]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def words_of(self, text: bytes) -> list[bytes | int]:
        """Words of a piece of text; added tokens as their ids."""
        out: list[bytes | int] = []
        at = 0
        for found in [*self.special.finditer(text), None]:
            part = text[at:found.start() if found else len(text)].decode("utf-8")
            if part:
                part = self.normalizer.normalize_str(part) if self.normalizer else part
                split = self.splitter.pre_tokenize_str(part) if part else []
                out += [bytes(map(self.to_byte.__getitem__, piece)) for piece, _ in split if piece]
            if found:
                out.append(self.added[found.group()])
                at = found.end()
        return out

    def split_latin(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all words, size of each, its chunk, chunks left over) for chunks without white space.

        All chunks are lowered and split at once, by where the kind of their characters changes; those
        with a character that is odd or beyond Latin, or with a special token, are left over.
        """
        if not self.as_words:
            return (*(np.zeros(0, np.int64) for _ in range(3)), np.arange(len(chunks)))
        text = b" ".join(chunks).decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = KINDS[np.minimum(points, LATIN)]
        blank = kinds == BLANK
        chunk = np.cumsum(blank)
        odd = kinds == ODD
        odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
        left = np.zeros(len(chunks), bool)
        left[chunk[odd]] = True
        if left.any():  # again without them: what is left changes its length in no way
            kept = np.flatnonzero(~left)
            if len(kept) == len(chunks) or not len(kept):
                return (*(np.zeros(0, np.int64) for _ in range(3)), np.flatnonzero(left))
            data, sizes, owner, _ = self.split_latin([chunks[k] for k in kept.tolist()])
            return data, sizes, kept[owner], np.flatnonzero(left)
        low = text.lower()
        points = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(low.encode("utf-8"), np.uint8)
        first = np.ones(len(kinds), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        begin = np.flatnonzero(first & ~blank)
        place = np.cumsum(np.where(points < 128, 1, 2)) - np.where(points < 128, 1, 2)
        inside = np.flatnonzero(data != 32)  # a blank's byte is in no other character
        word_of_byte = np.cumsum(np.bincount(place[begin], minlength=len(data)))[inside] - 1
        return data[inside], np.bincount(word_of_byte, minlength=len(begin)), chunk[begin], np.zeros(0, np.int64)

    def _drops_blanks(self) -> bool:
        """Whether no word reaches over white space, so that a text can be cut there."""
        return self.words_of(b" one two\n\n three\t") == [b"one", b"two", b"three"]

    def _splits_as_words(self) -> bool:
        """Whether the file splits Latin text by kind of character, in lower case."""
        self.as_words = self.split_on_blanks
        letters = [chr(c) for c in range(33, LATIN)]
        tests = [t.encode() for t in [*letters, *(f"{c}a{c}{c}1{c}.{c}" for c in letters), "we'll", "a1b22..x", "\x01\x02a\x1c\x7f"]]
        data, sizes, chunk, left = self.split_latin(tests)
        stops = np.cumsum(sizes)
        words: list[list[bytes]] = [[] for _ in tests]
        for stop, size, k in zip(stops.tolist(), sizes.tolist(), chunk.tolist(), strict=True):
            words[k].append(data[stop - size:stop].tobytes())
        odd = set(left.tolist())
        return self.split_on_blanks and all(self.words_of(t) == words[k] for k, t in enumerate(tests) if k not in odd)

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.zeros(1 << 16, np.int32)
        self.bounds = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.failed = self.tried = 0

    def _shrink(self, room: int) -> None:
        """Keeps the most used chunks, as many as half the table and ``room`` new ones allow."""
        keep = max(0, min(CACHE // 2, CACHE - room))
        top = np.sort(np.argsort(-self.uses, kind="stable")[:keep])
        wanted = set(top[self.uses[top] > 1].tolist())
        kept = [(c, k) for c, k in self.number.items() if k in wanted]
        places = np.array([k for _, k in kept], np.int64)
        start, count = self.bounds[places], np.diff(self.bounds)[places]
        flat = self.table[_ranges(start, count)]
        self.table = np.concatenate([flat, np.zeros(1 << 16, np.int32)])
        self.bounds = np.concatenate([[0], np.cumsum(count)])
        self.number = {c: i for i, (c, _) in enumerate(kept)}
        self.uses = self.uses[places] // 2

    def _learn(self, chunks: list[bytes]) -> None:
        """Adds the ids of new chunks to the table."""
        data, sizes, chunk, left = self.split_latin(chunks)
        slow = [(w, k) for k in left.tolist() for w in self.words_of(chunks[k])]
        spelled = [(w, k) for w, k in slow if isinstance(w, bytes)]
        ids, counts = self.encode_words(
            np.concatenate([data, np.frombuffer(b"".join(w for w, _ in spelled), np.uint8)]).astype(np.uint8),
            np.concatenate([sizes, np.array([len(w) for w, _ in spelled], np.int64)]),
        )
        # Added tokens are words of one id. A chunk's words keep their order: all of them went one way.
        stops = np.cumsum(counts)
        known = np.array([w for w, _ in slow if isinstance(w, int)], np.int64)
        start = np.concatenate([stops - counts, len(ids) + np.arange(len(known))])
        counts = np.concatenate([counts, np.ones(len(known), np.int64)])
        ids = np.concatenate([ids, known])
        chunk = np.concatenate([chunk, np.array([k for _, k in spelled], np.int64), np.array([k for w, k in slow if isinstance(w, int)], np.int64)])
        nth = np.concatenate([np.arange(len(sizes)), *(
            np.array([i for i, (w, _) in enumerate(slow) if isinstance(w, kind)], np.int64) for kind in (bytes, int)
        )])
        order = np.lexsort([nth, chunk])
        flat = ids[_ranges(start[order], counts[order])]
        used = int(self.bounds[-1])
        while used + len(flat) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[used:used + len(flat)] = flat
        sizes = np.bincount(chunk, counts, minlength=len(chunks)).astype(np.int64)
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks)), strict=True))
        self.bounds = np.concatenate([self.bounds, used + np.cumsum(sizes)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        parts = [t.split() if self.split_on_blanks else [t] * bool(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = list(chain.from_iterable(parts))
        chunk = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(chunk < 0).tolist()
        if unknown:
            new = list(dict.fromkeys([flat[i] for i in unknown]))
            if len(self.number) + len(new) > CACHE:
                self._shrink(len(new))
                unknown = range(len(flat))
                new = [c for c in dict.fromkeys(flat) if c not in self.number]
            self._learn(new)
            chunk[unknown] = np.fromiter((self.number[flat[i]] for i in unknown), np.int64, len(unknown))
        used = np.bincount(chunk, minlength=len(self.number))
        used[:len(self.uses)] += self.uses
        self.uses = used
        start, count = self.bounds[chunk], self.bounds[chunk + 1] - self.bounds[chunk]
        totals = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.table[_ranges(start, count)], np.diff(totals)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """Loaded once per worker."""
    return Tokenizer(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    found = Decoder(path)
    del found.spec
    return found


def _blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    """UTF-8 texts, about ``BLOCK`` bytes at a time; null is empty."""
    block, total = [], 0
    for text in texts.cast(pa.large_binary()):
        block.append(text.as_py() or b"")
        total += len(block[-1])
        if total >= BLOCK:
            yield block
            block, total = [], 0
    if block:
        yield block


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text in ``out``, as the tokenizers library gives them for the
    file at ``path`` without added special tokens; strings of special tokens in a text are those.

    Null and empty texts have no ids. Rows, ties and repeats included, stay as they are; all other
    columns are kept, but for one named ``out``. Every executor opens ``path``.
    """

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            for block in _blocks(batch):
                found, sizes = own.encode(block)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))

    return docs.withColumn(out, ids(F.col(text).cast("string")))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids; null ids give an empty text."""

    @F.arrow_udf(StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = decoder(path)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                yield pa.array([own.decode(found.values.to_pylist() if found.is_valid else []) for found in part], pa.string())

    return rows.withColumn(out, texts(F.col(ids)))
