"""Zero-shot labels from pairs: a comment, and a hypothesis for each candidate label.

A pair model says how much a comment entails a hypothesis. Equal comments are scored once, wherever they
stand. Pairs reach the model in batches of about equal length, filled up to a number of words, so
that little of a padded batch is padding and none outgrows memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlab.functions.registry import LABEL_MAP
from threadlab.operators import minibatch
from threadlab.operators.scoring import Scorer
from threadlab.operators.training import TrainConfig

TEMPLATE = "This comment is about {}."
BUDGET = 16_384  # words of a batch, padding included

Pair = tuple[str, str]
# Called once per task; the model gives one entailment score per pair.
PairLoader = Callable[[], Callable[[list[Pair]], Sequence[float]]]


def hypotheses(labels: Sequence[str], template: str = TEMPLATE) -> list[str]:
    return [template.format(label) for label in labels]


def filled_batches(sizes: Sequence[int], budget: int = BUDGET) -> Iterator[list[int]]:
    """Places of pairs, short ones first: as many as keep longest times number within the budget, one at least."""
    batch: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        if batch and sizes[i] * (len(batch) + 1) > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def pair_scorer(load: PairLoader, statements: Sequence[str], budget: int = BUDGET) -> Scorer:
    """A scorer for ``zero_shot``: one score per statement, by a model of (comment, statement) pairs.

    Rows not to be scored arrive as nulls; they get zeros and never reach the model, which is not even
    loaded by a task without a comment. Distinct comments are dealt to the tasks, scored, and joined
    with the rows; adaptive execution splits a comment with very many rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        lengths = [len(s.split()) for s in statements]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            model = model or load()
            pairs = [(t, s) for t in texts for s in statements]
            sizes = [len(t.split()) + n for t in texts for n in lengths]
            scores = np.zeros(len(pairs))
            for places in filled_batches(sizes, budget):
                scores[places] = np.asarray(model([pairs[i] for i in places]), dtype=float)
            found = list(scores.reshape(len(texts), len(statements)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["_text", "_found"])

    def score(df: DataFrame, text: str, out: str) -> DataFrame:
        distinct = df.select(F.col(text).alias("_text")).where("_text is not null").distinct()
        scored = distinct.mapInArrow(run, "_text string, _found array<double>")
        zeros = F.array(*[F.lit(0.0) for _ in statements])
        joined = df.join(scored, F.col(text) == F.col("_text"), "left")
        return joined.withColumn(out, F.coalesce("_found", zeros)).drop("_text", "_found")

    return score


# ---- a small pair model, trained here


@dataclass
class PairModel:
    """Entailment as the logit of a linear classifier of words paired with hypotheses."""

    weights: np.ndarray
    idf: np.ndarray
    max_length: int

    def __call__(self, pairs: list[Pair]) -> np.ndarray:
        n = len(self.idf)
        slots = [pair_slots(t, s, self.max_length, n) for t, s in pairs]
        lists = pa.array(slots, pa.list_(pa.int32()))
        out = np.zeros(len(pairs))
        for i in range(0, len(pairs), 512):
            at = np.arange(i, min(i + 512, len(pairs)))
            z = minibatch.logits(self.weights, (n, 2), minibatch.words_of(lists, at, n), self.idf)[-1]
            out[at] = z[:, 1] - z[:, 0]
        return out


def pair_slots(text: str, statement: str, max_length: int, n_features: int) -> list[int]:
    """A column for each of the first words of the text together with the statement."""
    seed = xxhash.xxh32_intdigest(statement)
    return [xxhash.xxh32_intdigest(w, seed) % n_features for w in text.lower().split()[:max_length]]


def train_pairs(
    gold: DataFrame, labels: Sequence[str], cfg: TrainConfig | None = None, template: str = TEMPLATE,
    text: str = "comment", label: str = "label", id_col: str = "id", seed: int = 42, mapping: Mapping[str, str] = LABEL_MAP,
) -> PairModel:
    """Learns which statements a comment entails from gold rows: its own label's, none of the others.

    A gold label is a candidate's own if it is the candidate or what ``mapping`` makes of it, in either
    case; so all candidates mapped to the gold label are entailed. A tenth of the ids is kept for
    validation. Rows without text or label are left out.
    """
    cfg = cfg or TrainConfig(n_features=8192)
    rows = gold.dropna(subset=[text, label])
    own = [sorted({name.lower(), mapping.get(name, name).lower()}) for name in labels]
    pair = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(statement).alias("statement"), F.array(*map(F.lit, names)).alias("own"))
        for name, statement, names in zip(labels, hypotheses(labels, template), own, strict=True)
    ]))

    @F.arrow_udf("array<int>")
    def slots(texts: pa.Array, statements: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), statements.to_pylist(), strict=True)
        return pa.array([pair_slots(t, s, cfg.max_length, cfg.n_features) for t, s in pairs], pa.list_(pa.int32()))

    held = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(10)) == 0
    made = rows.select(id_col, text, label, pair.alias("p")).select(
        F.lit("pairs").alias("experiment_name"), F.lit(0).alias("fold"), F.when(held, 2).otherwise(0).cast("long").alias("val_mask"),
        F.array_contains("p.own", F.lower(label)).cast("int").alias("label_id"), slots(F.col(text), F.col("p.statement")).alias("slots"),
        F.xxhash64(id_col, "p.name").alias("pair_id"),
    )
    run = minibatch.Run("pairs", "entailment", 1, (cfg.n_features, 2), seed)
    (fitted,) = minibatch.train(made, [run], {"pairs": ["no", "yes"]}, cfg, "pair_id", seed)
    return PairModel(fitted.weights, fitted.idf, cfg.max_length)
