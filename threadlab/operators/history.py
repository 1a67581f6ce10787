"""Training histories: early stopping, best epoch, plot points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def early_stopping(
    history: DataFrame,
    patience: int = 2,
    run: Sequence[str] = ("run",),
    epoch: str = "epoch",
    metric: str = "eval_metric",
) -> DataFrame:
    """``(run..., stop_epoch, best_epoch, best_metric)`` for each run.

    Training stops at the first epoch with ``patience`` evaluations since the last strict
    improvement, or at the last epoch; the best epoch is the earliest maximum up to the stop.
    Windows hold one run, which has one row per epoch.
    """
    ordered = W.partitionBy(*run).orderBy(epoch)
    past = ordered.rowsBetween(W.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    best_before = F.max(metric).over(past)
    steps = (
        history.filter(F.col(metric).isNotNull())
        .withColumn("_i", F.row_number().over(ordered))
        .withColumn("_improved", best_before.isNull() | (F.col(metric) > best_before))
        .withColumn("_last", F.max(F.when(F.col("_improved"), F.col("_i"))).over(so_far))
        .withColumn("_stale", F.col("_i") - F.col("_last"))
    )
    whole = W.partitionBy(*run)
    stop = F.coalesce(
        F.min(F.when(F.col("_stale") >= patience, F.col(epoch))).over(whole), F.max(epoch).over(whole)
    )
    return (
        steps.withColumn("stop_epoch", stop)
        .filter(F.col(epoch) <= F.col("stop_epoch"))
        .groupBy(*run)
        .agg(
            F.max("stop_epoch").alias("stop_epoch"),
            F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"),
            F.max(metric).alias("best_metric"),
        )
    )


def should_stop(metrics: Sequence[float], patience: int) -> bool:
    """The same rule for a run in progress, on its evaluations so far."""
    best = 0
    for i, value in enumerate(metrics):
        if value > metrics[best]:
            best = i
    return len(metrics) - 1 - best >= patience


def learning_curve(history: DataFrame, run: Sequence[str] = ("run",), metric: str = "eval_metric") -> DataFrame:
    """Plot points ``(run..., epoch, series, value)``; log lines without a value are left out."""
    points = F.array(
        F.struct(F.lit("loss").alias("series"), F.col("loss").cast("double").alias("value")),
        F.struct(F.lit(metric).alias("series"), F.col(metric).cast("double").alias("value")),
    )
    return history.select(*run, "epoch", F.inline(points)).filter("value IS NOT NULL")
