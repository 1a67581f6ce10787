"""Settings of training, text features, and the classifier that Spark ML fits in one go.

The classifiers trained by epoch are in ``minibatch``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threadlab.functions.text import first_words
from threadlab.operators import metrics

RATES = ("precision", "recall", "f1")


@dataclass(frozen=True)
class TrainConfig:
    """``batch_size`` training rows make a step; ``learning_rate`` falls to zero over all steps of all
    epochs; ``weight_decay`` is decoupled from the gradient; a task scores ``eval_batch_size`` rows at
    once. ``steps_per_epoch`` times ``epochs`` are the iterations of models fitted in one go."""

    max_length: int = 256
    n_features: int = 1024
    epochs: int = 10
    learning_rate: float = 0.05
    batch_size: int = 1024
    eval_batch_size: int = 2048
    steps_per_epoch: int = 5
    patience: int = 2
    weight_decay: float = 0.01
    best_metric: str = "macro_f1"


@dataclass
class Trained:
    """The best model, its history rows (epoch, loss, metrics...) and the epoch it comes from."""

    model: Model
    history: list[dict] = field(default_factory=list)
    best_epoch: int = 0

    def validation(self) -> dict[str, float]:
        """Validation metrics of the best epoch."""
        line = next(h for h in self.history if h["epoch"] == self.best_epoch)
        return {k.removeprefix("eval_"): v for k, v in line.items() if k.startswith("eval_")}


def term_frequencies(
    df: DataFrame, text: str, max_length: int, n_features: int, out: str = "tf"
) -> DataFrame:
    """Hashed counts of the first ``max_length`` words; row-local, so computed once for all folds."""
    tokens = df.withColumn("_tokens", first_words(text, max_length))
    return HashingTF(numFeatures=n_features, inputCol="_tokens", outputCol=out).transform(tokens).drop("_tokens")


def weighted_features(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Add ``features``: counts weighted by document frequencies of the training rows only."""
    idf = IDF(inputCol="tf", outputCol="features").fit(train)
    return [idf.transform(df) for df in (train, *others)]


def predict(model: Model, df: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """``df`` with predicted label, largest raw score and largest probability, as separate columns."""
    names = F.array(*[F.lit(c) for c in classes])
    out = model.transform(df)
    return out.withColumns(
        {
            "predicted_label": F.element_at(names, F.col("prediction").cast("int") + 1),
            "max_logit": F.array_max(vector_to_array("rawPrediction")),
            "max_prob": F.array_max(vector_to_array("probability")),
            "gold_label": F.col(label),
        }
    ).drop("rawPrediction", "probability", "prediction", "features", "tf")


def evaluate(predictions: DataFrame, classes: Sequence[str]) -> dict[str, float]:
    """Headline and per-class metrics as a dict, with the names of ``metrics.metric_rows``.

    Averages run over gold and predicted labels; a declared class that neither has gets zeros.
    """
    counts = metrics.confusion_counts(predictions, "gold_label", "predicted_label")
    report = metrics.classification_report(counts, grid="union")
    lines = metrics.metric_rows(report, []).collect()
    found = {r["metric"]: r["value"] for r in lines if r["value"] is not None}
    names = [f"{c.replace('-', '_').replace(' ', '_')}_{m}" for c in classes for m in (*RATES, "support")]
    names += [*[f"macro_{m}" for m in RATES], "weighted_f1", "accuracy"]
    return {**dict.fromkeys(names, 0.0), **found}


def train_logreg(train: DataFrame, val: DataFrame, classes: Sequence[str], cfg: TrainConfig, seed: int) -> Trained:
    """Multinomial logistic regression, fitted in one go: Spark's has no warm start.

    Its history is the objective per iteration, with the validation metrics on the last line.
    """
    estimator = LogisticRegression(
        featuresCol="features", labelCol="label_id", family="multinomial",
        maxIter=cfg.epochs * cfg.steps_per_epoch, regParam=cfg.weight_decay,
    )
    model = estimator.fit(train)
    scores = evaluate(predict(model, val, classes), classes)
    losses = [float(x) for x in model.summary.objectiveHistory]
    history = [{"epoch": i + 1, "loss": x} for i, x in enumerate(losses)]
    history[-1].update({f"eval_{k}": v for k, v in scores.items()})
    return Trained(model, history, len(history))


# Hidden layers of the two families trained by epoch, which run per experiment by default; models
# that Spark ML fits in one go, on request.
NETWORKS: dict[str, tuple[int, ...]] = {"softmax": (), "hidden": (16,)}
MODELS: dict[str, Callable[..., Trained]] = {"logreg": train_logreg}
DEFAULT_MODELS = {"softmax": "hashed-tfidf-softmax", "hidden": "hashed-tfidf-hidden"}


def observed_write(
    predictions: DataFrame, write: Callable[[DataFrame], DataFrame], seconds: str | None = "inference_time_sec"
) -> tuple[DataFrame, dict[str, float]]:
    """Write ``predictions``; returns the written rows and what the write itself counted: ``rows``,
    ``errors`` (rows with a true label that is not the predicted one) and ``seconds`` inside models,
    null without that column."""
    seen = Observation()
    wrong = F.col("gold_label").isNotNull() & ~F.col("gold_label").eqNullSafe(F.col("predicted_label"))
    spent = F.sum(seconds) if seconds else F.sum(F.lit(None).cast("double"))
    watched = predictions.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("errors"), spent.alias("seconds")
    )
    return write(watched), seen.get


def timed_write(predictions: DataFrame, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, float | None]:
    """For models whose time cannot be taken apart: the written rows, and the seconds of the write per row."""
    start = time.perf_counter()
    written, seen = observed_write(predictions, write, None)
    seconds = time.perf_counter() - start
    return written, seconds / seen["rows"] if seen["rows"] else None
