"""Label assignment: scorers give every comment one score per candidate label.

A scorer adds an array column aligned with the candidate labels.  Soft-max, arg-max and label
mapping then work inside the row, so labelling never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlab.functions.registry import DEFAULT_LABEL
from threadlab.functions.scores import pick_label, softmax
from threadlab.functions.text import is_valid_comment, letters
from threadlab.operators.labels import map_labels

# scorer(df, input column, out): df with out, an array<double> with one raw score per candidate
# label; the input is null for rows that must not be scored.
Scorer = Callable[[DataFrame, str, str], DataFrame]

# A scorer's model: called once per task, returns batch -> (rows, labels) raw scores.
ModelLoader = Callable[[], Callable[[list[str]], Iterable[Sequence[float]]]]


def lexicon_scorer(
    labels: Sequence[str],
    terms: Mapping[str, Sequence[str]],
    priors: Mapping[str, float] | None = None,
) -> Scorer:
    """Score = occurrences of the label's terms + its prior, so that no hit means the prior's label."""
    priors = priors or {}

    def label_score(label: str) -> Column:
        base, words = F.lit(float(priors.get(label, 0.0))), list(terms.get(label, ()))
        if not words:
            return base
        return base + F.size(F.filter("_tokens", lambda t: t.isin(words))).cast("double")

    def score(df: DataFrame, text: str, out: str) -> DataFrame:
        # Tokens are a column of their own so that they are cut once, not once per label.
        tokens = df.withColumn("_tokens", F.coalesce(letters(text), F.array().cast("array<string>")))
        return tokens.withColumn(out, F.array(*[label_score(x) for x in labels])).drop("_tokens")

    return score


def model_scorer(load: ModelLoader, n_labels: int) -> Scorer:
    """Scores from a user model on Arrow batches; the model is loaded once per task.

    Only the text crosses to Python.  A SQL CASE does not keep a Python function from running, so
    rows not to be scored arrive as nulls and are skipped here; they get zeros.
    """

    @F.pandas_udf("array<double>")
    def run_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            out = np.zeros((len(batch), n_labels))
            wanted = batch.notna().to_numpy()
            if wanted.any():
                model = model or load()
                out[wanted] = np.asarray(list(model(batch[wanted].tolist())), dtype=float)
            yield pd.Series(list(out))

    return lambda df, text, out: df.withColumn(out, run_model(text))


def zero_shot(
    df: DataFrame,
    labels: Sequence[str] | Column,
    scorer: Scorer,
    mapping: Mapping[str, str],
    text: str = "comment",
    min_words: int = 3,
    default_label: str = DEFAULT_LABEL,
) -> DataFrame:
    """Add ``pred_label``, ``pred_label_mapped`` and ``pred_score`` (soft-max of the best label).

    Comments too short, removed or missing get the default label with score 1 and are not scored.
    ``labels`` may be an array column, for rows with candidate labels of their own.
    """
    masked = df.withColumn("_valid", is_valid_comment(text)).withColumn(
        "_input", F.when(F.col("_valid"), F.col(text))
    )
    scored = scorer(masked, "_input", "_scores")
    scores = F.col("_scores")
    labelled = scored.withColumns(
        {
            "pred_label": F.when(F.col("_valid"), pick_label(labels, scores)).otherwise(
                F.lit(default_label)
            ),
            "pred_score": F.when(F.col("_valid"), F.array_max(softmax(scores))).otherwise(F.lit(1.0)),
        }
    ).drop("_valid", "_input", "_scores")
    return map_labels(labelled, mapping)


def topic_scorer(scorers: Mapping[str, Scorer], topic: str = "topic") -> Scorer:
    """One scorer of many: each row gets the scores of its topic's scorer, other scorers see it as null."""

    def score(df: DataFrame, text: str, out: str) -> DataFrame:
        chosen = F.lit(None).cast("array<double>")
        for i, (name, scorer) in enumerate(scorers.items()):
            is_own = F.col(topic) == name
            df = scorer(df.withColumn(f"_own{i}", F.when(is_own, F.col(text))), f"_own{i}", f"_by{i}")
            chosen = F.when(is_own, F.col(f"_by{i}")).otherwise(chosen)
        spent = [f"_{kind}{i}" for i in range(len(scorers)) for kind in ("own", "by")]
        return df.withColumn(out, chosen).drop(*spent)

    return score


def argmax_label(scores: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Best label per key of long ``(key..., label, pos, score)``; ties go to the lowest ``pos``.

    A plain aggregate: no sort, and partial results combine before the shuffle.
    """
    best = F.struct("score", -F.col("pos"))
    return scores.groupBy(*key).agg(
        F.max_by("label", best).alias("pred_label"), F.max("score").alias("pred_score")
    )


def label_ranking(scores: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """All labels of a key by falling score, then ``pos``; a key has one row per candidate label."""
    window = W.partitionBy(*key).orderBy(F.desc("score"), "pos")
    return scores.withColumn("rank", F.row_number().over(window))


def label_prototypes(
    df: DataFrame, dims: int, vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``(label, prototype array<double>, n)``: element-wise mean vector of each label's rows.

    One aggregate per element, combined before the shuffle: a dominant label sends one partial row
    per task, and vectors are never exploded.
    """
    means = F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dims)])
    return df.groupBy(label).agg(means.alias("prototype"), F.count(F.lit(1)).alias("n"))


def prototype_scorer(prototypes: np.ndarray) -> Scorer:
    """Cosine between an embedding column and each row of a (labels, dims) matrix.

    The matrix has one row per candidate label, so it travels with the function.
    """
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<double>")
    def cosines(vectors: pd.Series) -> pd.Series:
        out = np.zeros((len(vectors), len(unit)))
        wanted = vectors.notna().to_numpy()
        if wanted.any():
            m = np.stack(vectors[wanted].to_numpy()).astype(float)
            length = np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            out[wanted] = (m / length) @ unit.T
        return pd.Series(list(out))

    return lambda df, vector, out: df.withColumn(out, cosines(vector))


def collect_prototypes(prototypes: DataFrame, labels: Sequence[object], label: str = "label") -> np.ndarray:
    """The prototypes of the candidate labels as a matrix, in label order."""
    found = {
        r[label]: r["prototype"]
        for r in prototypes.filter(F.col(label).isin(list(labels))).collect()
    }
    missing = [x for x in labels if x not in found]
    if missing:
        raise ValueError(f"labels without rows: {missing}")
    return np.array([found[x] for x in labels], dtype=float)
