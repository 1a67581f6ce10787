"""Classification metrics from one confusion count.

Rows are aggregated once to (group, true label, predicted label, n); partial aggregation leaves at
most k*k rows per group and task, so a dominant class or group cannot overload a task.  Everything
below works on those counts.  ``group`` may hold any columns (topic, model, fold, ...): one job
evaluates every experiment.

``grid`` says which classes the metrics run over:
  gold      labels that occur as truth
  union     labels that occur as truth or prediction
  declared  an explicit list; a class that never occurs gets a zero row
Counts of all rows (accuracy, N) never depend on the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.functions.scores import harmonic, ratio

GRIDS = ("gold", "union", "declared")


def confusion_counts(
    df: DataFrame, gold: str = "gold", pred: str = "pred", group: Sequence[str] = ()
) -> DataFrame:
    """``(group..., true_label, pred_label, n)``, observed cells only."""
    return df.groupBy(
        *group, F.col(gold).alias("true_label"), F.col(pred).alias("pred_label")
    ).agg(F.count(F.lit(1)).alias("n"))


def _check(grid: str, classes: Sequence[str] | None) -> None:
    if grid not in GRIDS:
        raise ValueError(f"grid is one of {GRIDS}")
    if (grid == "declared") != (classes is not None):
        raise ValueError("classes go with grid='declared'")


def _labels(grid: str, classes: Sequence[str] | None) -> Column:
    """Aggregate giving a group's class list; its size is bounded by the label vocabulary."""
    if grid == "declared":
        return F.first(F.array(*[F.lit(c) for c in classes]))
    if grid == "gold":
        return F.array_compact(F.collect_set("true_label"))
    return F.array_compact(F.array_union(F.collect_set("true_label"), F.collect_set("pred_label")))


def confusion_matrix(
    counts: DataFrame,
    group: Sequence[str] = (),
    grid: str = "gold",
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """Every (true, predicted) cell of the class grid, absent cells as 0."""
    _check(grid, classes)
    cell = F.struct(F.struct("true_label", "pred_label"), "n")
    per_group = counts.groupBy(*group).agg(
        _labels(grid, classes).alias("labels"),
        F.map_from_entries(F.collect_list(cell)).alias("cells"),
    )
    rows = per_group.select(*group, "labels", "cells", F.explode("labels").alias("true_label"))
    pairs = rows.select(*group, "cells", "true_label", F.explode("labels").alias("pred_label"))
    n = F.try_element_at("cells", F.struct("true_label", "pred_label"))
    return pairs.select(*group, "true_label", "pred_label", F.coalesce(n, F.lit(0)).alias("n"))


def wide_matrix(
    matrix: DataFrame, classes: Sequence[str], group: Sequence[str] = (), value: str = "n"
) -> DataFrame:
    """A long matrix as one row per true label and one column per class of ``classes``."""
    return matrix.groupBy(*group, "true_label").pivot("pred_label", list(classes)).sum(value)


def confusion_matrix_wide(
    counts: DataFrame,
    classes: Sequence[str],
    group: Sequence[str] = (),
    grid: str = "declared",
) -> DataFrame:
    """Confusion counts in wide form."""
    matrix = confusion_matrix(counts, group, grid, classes if grid == "declared" else None)
    return wide_matrix(matrix, classes, group)


def confusion_matrix_normalized(
    counts: DataFrame,
    group: Sequence[str] = (),
    grid: str = "union",
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """Cells as a share of their true label; a label without rows gives zeros."""
    _check(grid, classes)
    cell = F.struct(F.struct("true_label", "pred_label"), "n")
    per_group = counts.groupBy(*group).agg(
        _labels(grid, classes).alias("labels"),
        F.map_from_entries(F.collect_list(cell)).alias("cells"),
    )
    rows = per_group.select(*group, "labels", "cells", F.explode("labels").alias("true_label"))
    row_cells = F.transform(
        "labels",
        lambda p: F.coalesce(
            F.try_element_at(
                "cells", F.struct(F.col("true_label").alias("true_label"), p.alias("pred_label"))
            ),
            F.lit(0),
        ),
    )
    rows = rows.withColumn("ns", row_cells)
    total = F.aggregate("ns", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    cells = F.arrays_zip(F.col("labels").alias("pred_label"), F.col("ns").alias("n"))
    return rows.select(
        *group, "true_label", total.alias("total"), F.inline(cells).alias("pred_label", "n")
    ).select(*group, "true_label", "pred_label", ratio(F.col("n"), F.col("total")).alias("share"))


def class_totals(
    counts: DataFrame,
    group: Sequence[str] = (),
    grid: str = "gold",
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """``(group..., label, tp, pred_n, support, total, correct)`` without a join.

    Each cell adds its count to its true label (support) and to its predicted label (pred_n); the
    diagonal is tp.  Cells without a true label are left out.  For a declared grid each group also gets a zero entry per class.
    """
    _check(grid, classes)
    zero = F.lit(0).cast("bigint")
    n, hit = F.col("n"), F.col("true_label").eqNullSafe(F.col("pred_label"))

    def entry(label: Column, support: Column, pred_n: Column, tp: Column) -> Column:
        return F.struct(
            label.alias("label"), support.alias("support"), pred_n.alias("pred_n"), tp.alias("tp")
        )

    entries = [
        entry(F.col("true_label"), n, zero, F.when(hit, n).otherwise(zero)),
        entry(F.col("pred_label"), zero, n, zero),
    ]
    if grid == "declared":
        entries += [entry(F.lit(c), zero, zero, zero) for c in classes]
    sums = [F.sum(c).alias(c) for c in ("support", "pred_n", "tp")]
    by_label = (
        counts.filter("true_label IS NOT NULL")
        .select(*group, F.inline(F.array(*entries)))
        .groupBy(*group, "label")
        .agg(*sums)
    )
    row = F.struct("label", "support", "pred_n", "tp")
    whole = by_label.groupBy(*group).agg(
        F.sum("support").alias("total"), F.sum("tp").alias("correct"), F.collect_list(row).alias("r")
    )
    kept = whole.select(*group, "total", "correct", F.inline("r")).filter("label IS NOT NULL")
    if grid == "gold":
        kept = kept.filter("support > 0")
    if grid == "declared":
        kept = kept.filter(F.col("label").isin(list(classes)))
    return kept


def _rates(totals: DataFrame) -> DataFrame:
    precision = ratio(F.col("tp"), F.col("pred_n"))
    recall = ratio(F.col("tp"), F.col("support"))
    return totals.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", harmonic(F.col("precision"), F.col("recall"))
    )


def per_class_metrics(
    counts: DataFrame,
    group: Sequence[str] = (),
    grid: str = "gold",
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """``(group..., label, precision, recall, f1, support)``."""
    return _rates(class_totals(counts, group, grid, classes)).select(
        *group, "label", "precision", "recall", "f1", "support"
    )


def accuracy(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``(group..., n, correct, accuracy)`` over all rows with a true label, whatever was predicted."""
    hit = F.col("true_label").eqNullSafe(F.col("pred_label"))
    summed = counts.filter("true_label IS NOT NULL").groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("correct")
    )
    return summed.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def _averages() -> list[Column]:
    support = F.sum("support")
    out = []
    for m in ("precision", "recall", "f1"):
        out.append(F.avg(m).alias(f"macro_{m}"))
        out.append(ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"weighted_{m}"))
    return out


def macro_weighted_averages(
    counts: DataFrame,
    group: Sequence[str] = (),
    grid: str = "union",
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """Plain and support-weighted means of precision, recall and F1, one row per group."""
    return (
        _rates(class_totals(counts, group, grid, classes))
        .groupBy(*group)
        .agg(
            *_averages(),
            ratio(F.first("correct"), F.first("total")).alias("accuracy"),
            F.sum("support").alias("support"),
        )
    )


def classification_report(
    counts: DataFrame,
    group: Sequence[str] = (),
    grid: str = "union",
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """Class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``, from one pass.

    The accuracy row carries its one value in ``f1`` and leaves precision and recall null.
    """
    row = F.struct("label", "precision", "recall", "f1", "support")
    per_group = (
        _rates(class_totals(counts, group, grid, classes))
        .groupBy(*group)
        .agg(
            F.collect_list(row).alias("rows"),
            *_averages(),
            ratio(F.first("correct"), F.first("total")).alias("acc"),
            F.first("total").alias("total"),
            F.sum("support").alias("support"),
        )
    )
    blank = F.lit(None).cast("double")

    def extra(label: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            support.alias("support"),
        )

    averages = [
        extra(
            f"{kind} avg",
            F.col(f"{kind}_precision"),
            F.col(f"{kind}_recall"),
            F.col(f"{kind}_f1"),
            F.col("support"),
        )
        for kind in ("macro", "weighted")
    ]
    extras = F.array(extra("accuracy", blank, blank, F.col("acc"), F.col("total")), *averages)
    return per_group.select(*group, F.inline(F.concat("rows", extras)))


def one_vs_rest_metrics(
    counts: DataFrame,
    group: Sequence[str] = (),
    grid: str = "declared",
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """Per class: TP, FP, TN, FN and five rates, each 0 where its denominator is 0."""
    totals = class_totals(counts, group, grid, classes)
    counted = totals.withColumns(
        {
            "fp": F.col("pred_n") - F.col("tp"),
            "fn": F.col("support") - F.col("tp"),
            "tn": F.col("total") - F.col("pred_n") - F.col("support") + F.col("tp"),
        }
    )
    rates = _rates(counted).withColumns(
        {
            "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("total")),
            "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp")),
        }
    )
    return rates.select(
        *group,
        F.col("label").alias("class"),
        "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "specificity", "f1",
    )


def binary_cells(one_vs_rest: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Long form of the four one-vs-rest counts: ``(group..., class, metric, value)``."""
    names = (("True Negative", "tn"), ("False Positive", "fp"),
             ("False Negative", "fn"), ("True Positive", "tp"))
    cells = F.array(
        *[F.struct(F.lit(text).alias("metric"), F.col(c).alias("value")) for text, c in names]
    )
    return one_vs_rest.select(*group, "class", F.inline(cells))


def misclassified(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Rows whose prediction is not their true label; rows without a true label are no errors, as they
    are no part of accuracy."""
    return df.filter(F.col(gold).isNotNull() & ~F.col(gold).eqNullSafe(F.col(pred)))


def error_analysis(
    df: DataFrame, order: Sequence[str], gold: str = "gold", pred: str = "pred", first: int = 50
) -> DataFrame:
    """The first errors in the stated order; sorted as a top-k, not as a full sort."""
    return misclassified(df, gold, pred).orderBy(*order).limit(first)


def metric_rows(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report rows as ``(keys..., metric, value)`` with names such as ``macro_f1``, each name once.

    Class names lose their hyphens; averages lose ``test_`` marks, and only F1 is kept of the weighted
    one. Where a class makes the name of an average (a class ``macro``), the class counts.
    """
    name = F.translate("label", "- ", "__")
    is_average = F.col("label").isin("macro avg", "weighted avg")
    prefix = F.when(is_average, F.element_at(F.split("label", " "), 1)).otherwise(name)

    def cell(m: str) -> Column:
        value = F.col(m).cast("double")
        return F.struct(F.concat(prefix, F.lit(f"_{m}")).alias("metric"), value.alias("value"))

    whole = F.col("label") == "accuracy"
    cells = (
        F.when(whole, F.array(F.struct(F.lit("accuracy").alias("metric"), F.col("f1").alias("value"))))
        .when(F.col("label") == "weighted avg", F.array(cell("f1")))
        .when(F.col("label") == "macro avg", F.array(*[cell(m) for m in ("precision", "recall", "f1")]))
        .otherwise(F.array(*[cell(m) for m in ("precision", "recall", "f1", "support")]))
    )
    of_class = ~(whole | is_average)
    named = report.select(*keys, of_class.alias("_of_class"), F.inline(cells))
    clean = named.withColumn("metric", F.when(F.col("_of_class"), F.col("metric")).otherwise(metric_name("metric")))
    return clean.groupBy(*keys, "metric").agg(F.max_by("value", "_of_class").alias("value"))


def fold_summary(
    fold_metrics: DataFrame,
    keys: Sequence[str] = ("experiment_name", "model_key", "model_name"),
) -> DataFrame:
    """Mean and sample standard deviation over folds of long ``(keys..., fold, metric, value)``.

    The deviation is 0 for a group with a single row; null values are left out of both figures.
    """
    return fold_metrics.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.when(F.count(F.lit(1)) == 1, F.lit(0.0)).otherwise(F.stddev_samp("value")).alias("std"),
    )


def metric_name(column: str | Column) -> Column:
    """Name of a test metric without its ``test_`` marks."""
    return F.replace(F.col(column) if isinstance(column, str) else column, F.lit("test_"), F.lit(""))
