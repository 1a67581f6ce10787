"""Language identification by a linear-chain conditional random field over words.

Every word of a line gets a label; features are its affixes, character n-grams, the word itself and
the lexicons learned per language; labels of neighbouring words are tied by learned transitions.
Forward-backward gives each word's label probabilities, also in text that changes its language. A
document's language is the one with the largest share of them.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 17
PER_LANGUAGE = 250  # documents of a language that are learned from
SAMPLE = 4_000  # documents that are learned from, at most, shared out among the languages
CHAINS = 64  # chains of a document that are learned from, at most: of longer ones those with the lowest hashes
EPOCHS = 30
RATE = 0.15
DECAY = 1e-7
CHAIN = 256  # words; a chain ends with its line or after so many words
SWITCH = 0.15  # share of training chains that are joined with one of another document
LEXICON_COUNT = 5
LEXICON_SHARE = 0.8
CACHE = 300_000
NONE = "und"
WORD = re.compile(r"[^\W\d_]+")


def _slots(mixed: np.ndarray, kind: int) -> np.ndarray:
    x = mixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xBF58476D1CE4E5B9 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot) of the features of lower-case words: the word, affixes up to three
    letters, bigrams and trigrams with the edges of the word."""
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(text)) - starts[owner]
    power = np.multiply.accumulate(np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64))
    whole = np.add.reduceat(text * power[place], starts) if len(words) else text
    owners, slots = [np.arange(len(words))], [_slots(whole, 0)]
    gram, wide = text, 1
    while True:  # strings of one, two and three characters
        first = starts + 1
        able = sizes - 2 >= wide
        owners += [np.flatnonzero(able)] * 2
        slots += [_slots(gram[first[able]], wide), _slots(gram[(starts + sizes - 1 - wide)[able]], 10 + wide)]
        if wide > 1:
            inside = np.flatnonzero(place[:len(gram)] + wide <= sizes[owner[:len(gram)]])
            owners.append(owner[inside])
            slots.append(_slots(gram[inside], 20 + wide))
        if wide == 3:
            return np.concatenate(owners), np.concatenate(slots)
        gram = gram[:-1] * np.uint64(0x1FFFFF) + text[wide:]
        wide += 1


def chains(text: str | None) -> list[list[str]]:
    """Words of a text by line, long lines in parts of ``CHAIN`` words."""
    out = []
    for line in (text or "").lower().split("\n"):
        found = WORD.findall(line)
        out += [found[i:i + CHAIN] for i in range(0, len(found), CHAIN)]
    return out


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, counts: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of each word, and (with ``counts``) the expected counts of transitions and
    of first labels.

    scores: emission scores of all words, chain after chain. All chains advance together.
    """
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    first = np.exp(start - start.max())
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]  # chains longer than t
    for t in range(longest):
        at = begins[:active[t]] + t
        a = emit[at] * (first if t == 0 else forward[at - 1] @ step)
        forward[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros_like(step)
    for t in range(longest - 2, -1, -1):
        at = begins[:active[t + 1]] + t
        onward = emit[at + 1] * backward[at + 1]
        b = onward @ step.T
        if counts:
            expected += _pairs(forward[at], onward, step)
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    return both, expected, both[begins].sum(axis=0)


def _pairs(before: np.ndarray, after: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Summed probabilities of label pairs of two neighbouring words."""
    norm = ((before @ step) * after).sum(axis=1)
    return ((before / norm[:, None]).T @ after) * step


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray  # languages x languages: weight of being in a language's lexicon
    lexicons: dict[str, int] = field(default_factory=dict)  # word -> language whose lexicon holds it
    known: Scores | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, slots = word_features(words)
        weight = self.weights[slots]
        out = np.stack([np.bincount(owner, w, minlength=len(words)) for w in weight.T], axis=1)
        held = [(i, self.lexicons[w]) for i, w in enumerate(words) if w in self.lexicons]
        if held:
            rows, langs = np.array(held).T
            out[rows] += self.lexicon[langs]
        return out


class Scores:
    """Emission scores of the words met so far; emptied when it holds too many."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.number) > CACHE:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.word_scores(new).astype(np.float32)])
        return self.table[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))]


def label(texts: list[str | None], model: Model, known: Scores) -> tuple[list[list[list[str]]], np.ndarray]:
    """Chains of each text and the label probabilities of all their words, in order."""
    found = [chains(t) for t in texts]
    flat = list(chain.from_iterable(found))
    if not flat:
        return found, np.zeros((0, len(model.languages)))
    lengths = np.array([len(part) for part in flat], np.int64)
    scores = known.of(list(chain.from_iterable(flat)))
    return found, forward_backward(scores, lengths, model.transitions, model.start, counts=False)[0]


def fit(docs: list[tuple[str, list[list[str]]]], epochs: int = EPOCHS) -> Model:
    """A model for (language, chains) pairs by Adam on the likelihood of the whole sample."""
    languages = sorted({lang for lang, _ in docs})
    size = len(languages)
    parts = [(languages.index(lang), part) for lang, found in docs for part in found]
    rng = np.random.default_rng(7)
    tags: list[np.ndarray] = []
    words: list[list[str]] = []
    for lang, part in parts:
        tag = np.full(len(part), lang)
        if rng.random() < SWITCH:  # code-switched chains teach the transitions
            other, more = parts[int(rng.integers(len(parts)))]
            part, tag = part + more, np.concatenate([tag, np.full(len(more), other)])
        words.append(part)
        tags.append(tag)
    model = Model(languages, np.zeros((1 << BITS, size)), np.zeros((size, size)), np.zeros(size), np.zeros((size, size)))
    if not words or size < 2:
        return model
    number: dict[str, int] = {}
    token = np.fromiter((number.setdefault(w, len(number)) for part in words for w in part), np.int64)
    gold = np.concatenate(tags)
    lengths = np.array([len(p) for p in words], np.int64)
    types = list(number)
    counts = np.zeros((len(types), size))
    np.add.at(counts, (token, gold), 1)
    share = counts / counts.sum(axis=1, keepdims=True)
    in_lexicon = (counts.sum(axis=1) >= LEXICON_COUNT) & (share.max(axis=1) >= LEXICON_SHARE)
    member = np.where(in_lexicon, counts.argmax(axis=1), size)  # the last row of the padded table is zero
    owner, flat = word_features(types)
    order = np.argsort(owner, kind="stable")
    owner, flat = owner[order], flat[order]
    offsets = np.searchsorted(owner, np.arange(len(types)))
    slots, inner = np.unique(flat, return_inverse=True)
    params = [np.zeros((len(slots), size)), np.zeros((size, size)), np.zeros(size), np.zeros((size, size))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    onehot = np.eye(size)[gold]
    ends = np.cumsum(lengths)
    inside = np.ones(len(token), bool)
    inside[ends - 1] = False
    at = np.flatnonzero(inside)
    moved = np.zeros((size, size))
    np.add.at(moved, (gold[at], gold[at + 1]), 1)
    began = np.bincount(gold[ends - lengths], minlength=size)
    n = len(token)
    for epoch in range(1, epochs + 1):
        w, transitions, start, lexicon = params
        table = np.add.reduceat(w[inner], offsets, axis=0) + np.concatenate([lexicon, np.zeros((1, size))])[member]
        both, pairs, first = forward_backward(table[token], lengths, transitions, start)
        error = both - onehot
        by_type = np.stack([np.bincount(token, error[:, k], minlength=len(types)) for k in range(size)], axis=1)
        spread = by_type[owner]
        gradients = [
            np.stack([np.bincount(inner, spread[:, k], minlength=len(slots)) for k in range(size)], axis=1) / n + DECAY * w,
            (pairs - moved) / n,
            (first - began) / n,
            np.stack([by_type[member == k].sum(axis=0) for k in range(size)]) / n,
        ]
        for p, g, (m, v) in zip(params, gradients, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    model.weights[slots] = params[0]
    model.transitions, model.start, model.lexicon = params[1:]
    model.lexicons = {w: int(member[i]) for w, i in number.items() if member[i] < size}
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of ids that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Learns from ``per_language`` documents (lowest hashed ids) of each language that are not held
    out, or as many as make ``sample`` in all if each language has the same number, one at least; rows
    without id, text or language are left out. None without any such row.

    The driver gets at most ``CHAINS`` chains of ``CHAIN`` words of each of these documents. Repeated
    rows of an id are documents of their own.
    """
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    drawn = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("draw"))
    total = drawn.groupBy("lang").agg(F.count("*").alias("n"))
    limit = max(1, min(per_language, sample // max(1, total.count())))
    # Few rows of a language are ranked, whatever its size: those whose draw is among the lowest.
    near = drawn.distinct().join(total, "lang").where(F.col("draw") * F.col("n") <= (3.0 * limit + 50) * 1_000_000)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    picked = near.withColumn("place", place).where(F.col("place") <= limit).orderBy("place", "doc_id", "lang").limit(sample)

    @F.pandas_udf("array<string>")
    def some_chains(texts: pd.Series) -> pd.Series:
        def chosen(text: str) -> list[str]:
            found = [" ".join(c) for c in chains(text)]
            if len(found) <= CHAINS:
                return found
            lowest = sorted(range(len(found)), key=lambda i: (zlib.crc32(found[i].encode()), i))[:CHAINS]
            return [found[i] for i in sorted(lowest)]

        return texts.map(chosen)

    rows = (  # texts are not shuffled: only those of the picked ids leave the scan
        usable.select("doc_id", "lang", "text")
        .join(F.broadcast(picked.select("doc_id", "lang", "place")), ["doc_id", "lang"])  # ``sample`` rows at most
        .orderBy("place", "doc_id", "lang", "text").limit(sample)
        .select("lang", some_chains("text").alias("chains")).collect()
    )
    return fit([(r.lang, [c.split(" ") for c in r.chains]) for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language over all
    words; they replace columns of those names. Texts without a letter (null and empty ones too) are
    ``und`` with score 0, as are all texts without a model. Ties go to the first language in order of
    name. Rows are labelled one by one, so repeated rows and null ids are labelled like others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        if own is None:
            return pd.DataFrame({"lang_pred": [NONE] * len(texts), "score": [0.0] * len(texts)})
        langs, scores = [], []
        known = own.known = own.known or Scores(own)  # lives as long as the worker
        for i in range(0, len(texts), 512):
            found, probabilities = label(list(texts[i:i + 512]), own, known)
            at = 0
            for parts in found:
                n = sum(map(len, parts))
                lettered = any(c.isalpha() for part in parts for w in part for c in w)
                mean = probabilities[at:at + n].mean(axis=0) if n else None
                at += n
                best = int(mean.argmax()) if n else -1
                langs.append(own.languages[best] if lettered else NONE)
                scores.append(min(1.0, float(mean[best])) if lettered else 0.0)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return (
        docs.withColumn("__found", predict("text"))
        .withColumn("lang_pred", F.col("__found.lang_pred"))
        .withColumn("score", F.col("__found.score"))
        .drop("__found")
    )
