"""Zero-shot labelling of the gold standard and its evaluation, all topics in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.functions.registry import COARSE_LABELS, LABEL_MAP, Topic, topics_frame
from threadlab.operators import metrics
from threadlab.operators.scoring import Scorer, topic_scorer, zero_shot


@dataclass
class Evaluation:
    accuracy: DataFrame
    matrix: DataFrame
    per_class: DataFrame
    averages: DataFrame
    report: DataFrame


def label_gold(
    gold: DataFrame,
    scorer: Scorer,
    labels: Sequence[str] | Column = COARSE_LABELS,
    mapping: Mapping[str, str] = LABEL_MAP,
    label: str = "label",
) -> DataFrame:
    """Gold rows with predicted, mapped and scored labels; gold labels in lower case."""
    rows = gold.withColumn("assigned_label", F.lower(label))
    return zero_shot(rows, labels, scorer, mapping).select(
        "id", "topic", "comment", "assigned_label", "pred_label", "pred_label_mapped", "pred_score"
    )


def label_topics(
    gold: DataFrame, topics: Sequence[Topic], scorers: Mapping[str, Scorer], label: str = "label"
) -> DataFrame:
    """Topics with candidate labels of their own, in one scan.

    ``scorers`` has one scorer per topic name. The registry joins as a table, so that candidate labels
    are a column; rows of topics outside it are left out. The topics share one label map.
    """
    mapping = topics[0].label_map
    if any(t.label_map != mapping for t in topics):
        raise ValueError("topics labelled together share one label map")
    registry = topics_frame(gold.sparkSession, topics).select("topic", "label_set")
    by_topic = topic_scorer({t.name: scorers[t.name] for t in topics})
    return label_gold(gold.join(registry, "topic"), by_topic, F.col("label_set"), mapping, label)


def evaluate(
    predictions: DataFrame,
    gold: str = "assigned_label",
    pred: str = "pred_label_mapped",
    group: Sequence[str] = ("topic",),
) -> Evaluation:
    """Every table of the evaluation from one confusion count.

    Matrix and class table run over gold labels; averages and report also count labels that were
    only predicted.
    """
    counts = metrics.confusion_counts(predictions, gold, pred, group)
    return Evaluation(
        accuracy=metrics.accuracy(counts, group),
        matrix=metrics.confusion_matrix(counts, group, "gold"),
        per_class=metrics.per_class_metrics(counts, group, "gold"),
        averages=metrics.macro_weighted_averages(counts, group, "union"),
        report=metrics.classification_report(counts, group, "union"),
    )
