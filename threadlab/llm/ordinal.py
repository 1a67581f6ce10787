"""Quality classifier: cumulative-link regression on graded ratings over hashed text.

All grades share one weight per hashed feature; ordered thresholds cut the score into grades:
P(grade <= k) = logistic(threshold_k - score). A document's expected grade and the probability of
the upper grades follow from its score.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from threadlab.llm.common import text_key

BITS = 18
SAMPLE = 8_000  # labelled documents that are learned from
EPOCHS = 150
RATE = 0.1
DECAY = 2e-4
CUT_DECAY = 0.2  # pull of the thresholds to the shares of the grades: a text without evidence gets those
BEARING = 4.0  # standard errors that the mean grade of a feature's documents must be off
MIN_DOCS = 4  # training documents a feature needs
KEEP = 0.5
CACHE = 200_000


def grade(quality: str = "quality", toxic: str = "toxic"):
    """0: toxic, 1: poor, 2: good. Null when both are null."""
    return (
        F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)
    )


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh32_intdigest(kind + value) & ((1 << BITS) - 1)


class Features(dict):
    """Feature numbers of a word: itself, its beginnings, its last characters, its case."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        low = word.lower()
        out = {_slot("w", low)} | {_slot("p", low[:n]) for n in (4, 5) if len(low) > n}
        if not word[-1].isalnum():
            out.add(_slot("e", "".join(c for c in word if not c.isalnum())))
        if len(word) > 1 and word.isupper():
            out.add(_slot("u", ""))
        self[word] = made = tuple(out)
        return made


def _reached(kind: str, share: float) -> set[int]:
    """One feature for each twentieth that a share reaches."""
    return {_slot(kind, str(k)) for k in range(1, int(20 * share) + 1)}


def features(text: str | None, known: Features) -> np.ndarray:
    """Distinct feature numbers of a whole text; none for null, empty and blank ones."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32)
    distinct = set(words)
    made = set(chain.from_iterable(map(known.__getitem__, distinct)))
    n = len(words)
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    shouted = sum(map(str.isupper, words)) / n
    marked = sum(not w[-1].isalnum() for w in words) / n
    made |= _reached("repeat", repeated) | _reached("shout", shouted) | _reached("marked", marked)
    made.add(_slot("size", str(n.bit_length())))
    return np.fromiter(made, np.int32, len(made))


@dataclass
class Model:
    weights: np.ndarray  # one per feature number
    thresholds: np.ndarray  # ascending, one less than grades
    bias: float = 0.0

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k), a column for each threshold."""
        z = self.thresholds[None, :] - scores[:, None]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) + self.bias

    def grades(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the highest grade."""
        low = self.at_most(scores)
        return (1 - low).sum(axis=1), 1 - low[:, -1]


def thresholds(theta: np.ndarray, k: int) -> np.ndarray:
    """The first one is a parameter, the next ones follow by steps whose logarithms are."""
    return theta[k] + np.concatenate([[0.0], np.cumsum(np.exp(theta[k + 1:]))])


def loss_and_gradient(
    theta: np.ndarray, flat: np.ndarray, owner: np.ndarray, grades: np.ndarray, k: int, prior: np.ndarray
) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with its penalties, and its gradient.

    theta: ``k`` weights, then the thresholds; ``flat`` and ``owner``: features and their documents.
    """
    n, w, cuts = len(grades), theta[:k], thresholds(theta, k)
    s = np.bincount(owner, w[flat], minlength=n)
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    sig = 1 / (1 + np.exp(-np.clip(edge[None, :] - s[:, None], -30, 30)))
    sig[:, 0], sig[:, -1] = 0.0, 1.0
    at = np.arange(n)
    hi, lo = sig[at, grades + 1], sig[at, grades]
    p = np.maximum(hi - lo, 1e-9)
    off = theta[k:] - prior
    loss = -np.log(p).mean() + DECAY * (w @ w) / 4 + CUT_DECAY * (off @ off) / 2
    d_hi, d_lo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
    gradient = np.zeros_like(theta)
    gradient[:k] = np.bincount(flat, (d_hi - d_lo)[owner], minlength=k) + DECAY * w / 2
    d_cut = np.array([d_lo[grades == j + 1].sum() - d_hi[grades == j].sum() for j in range(len(cuts))])
    gradient[k] = d_cut.sum()
    gradient[k + 1:] = [d_cut[j + 1:].sum() * step for j, step in enumerate(np.exp(theta[k + 1:]))]
    gradient[k:] += CUT_DECAY * off
    return float(loss), gradient


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int = 3, epochs: int = EPOCHS) -> Model:
    """Weights and thresholds by Adam on the whole sample.

    Fewer than two grades in the sample: zero weights, every document gets the best grade.
    """
    if len(set(grades.tolist())) < 2:
        return Model(np.zeros(1 << BITS), np.full(levels - 1, -30.0))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    count = np.bincount(flat, minlength=1 << BITS)
    # Features without a bearing on the grade only add noise: how far is their documents' mean grade off?
    shift = np.bincount(flat, (grades - grades.mean())[owner], minlength=1 << BITS)
    common = (count >= MIN_DOCS) & (np.abs(shift) >= BEARING * grades.std() * np.sqrt(np.maximum(count, 1)))
    slots = np.flatnonzero(common)
    renumber = np.full(1 << BITS, -1, np.int32)
    renumber[slots] = np.arange(len(slots))
    used = common[flat]
    flat, owner = renumber[flat[used]], owner[used]
    n, y = len(rows), grades
    share = np.cumsum([max((y == g).sum(), 1) for g in range(levels)])[:-1] / (n + levels)
    first = np.log(share / (1 - share))
    # Parameters: weights, first threshold, logarithms of the steps to the next ones.
    theta = np.concatenate([np.zeros(len(slots)), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    prior = theta[len(slots):].copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(slots)

    for step in range(1, epochs + 1):
        _, gradient = loss_and_gradient(theta, flat, owner, y, k, prior)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, cuts = theta[:k], thresholds(theta, k)
    weights = np.zeros(1 << BITS)
    weights[slots] = w
    return Model(weights, cuts)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the ``sample`` labelled documents with the lowest hashed ids.

    A document labelled twice takes the lower grade, of several texts of one id the one with the lowest
    ``text_key`` counts; rows without id or grade are left out, null and empty texts have no feature.
    Only feature numbers come to the driver, for at most ``sample`` documents.
    """
    graded = (
        labels.withColumn("grade", grade()).where("grade is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    @F.pandas_udf(BinaryType())  # 32-bit numbers: a twentieth of what lists of them take in the driver
    def numbers(texts: pd.Series) -> pd.Series:
        known = Features()
        return pd.Series([features(t, known).tobytes() for t in texts])

    rows = (
        docs.select("doc_id", "text").join(F.broadcast(graded), "doc_id")  # at most ``sample`` rows
        .select("grade", "doc_id", text_key("text").alias("text_key"), numbers("text").alias("found"))
        .groupBy("doc_id", "grade").agg(F.min(F.struct("text_key", "found")).alias("one"))
        .select("grade", F.col("one.found").alias("found"), "doc_id").orderBy("doc_id").collect()
    )
    if not rows:
        return fit([], np.zeros(0, np.int64))
    return fit([np.frombuffer(r.found, np.int32) for r in rows], np.array([r.grade for r in rows]))


def rate(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail`` (probability of the highest grade) and ``kept``, which
    replace columns of those names.

    Texts without a word (null, empty, blank) score zero: nothing speaks for or against them. Rows are
    rated one by one, so repeated rows and null ids are rated like others; ``tail`` at the limit is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        Model(model.weights.astype(np.float32), model.thresholds, model.bias)
    )

    @F.pandas_udf(ArrayType(FloatType()))
    def grades(texts: pd.Series) -> pd.Series:
        known, own = Features(), shared.value
        scores = np.array([own.score(features(t, known)) for t in texts])
        expected, tail = own.grades(scores)
        return pd.Series(list(np.stack([expected, tail], axis=1).astype(np.float32)))

    return (
        docs.withColumn("__grades", grades("text"))
        .withColumn("expected_grade", F.col("__grades")[0].cast("double"))
        .withColumn("tail", F.col("__grades")[1].cast("double"))
        .drop("__grades")
        .withColumn("kept", F.col("tail") >= keep)
    )
