from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import class_table, rows
from threadlab.operators import metrics


def counts_of(spark, gold, pred, group=None):
    data = [(g or "g", a, b) for g, a, b in zip(group or [None] * len(gold), gold, pred)]
    df = spark.createDataFrame(data, "grp string, gold string, pred string")
    return metrics.confusion_counts(df, group=["grp"])


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(5)
    gold = rng.choices(["belief", "fact-check", "other"], [1, 2, 7], k=400)
    # "political" is predicted but never true, "fact-check" never predicted right.
    pred = [rng.choice([g, "other", "political"]) if g != "fact-check" else "belief" for g in gold]
    return gold, pred


@pytest.mark.parametrize("grid", ["gold", "union", "declared"])
def test_class_rows_match_brute_force(spark, sample, grid):
    gold, pred = sample
    declared = ["belief", "fact-check", "never"] if grid == "declared" else None
    classes = declared or sorted(set(gold) | (set(pred) if grid == "union" else set()))
    want = class_table(gold, pred, classes)
    table = metrics.per_class_metrics(counts_of(spark, gold, pred), ["grp"], grid, declared)
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in table.collect()}
    assert set(got) == set(classes)
    for c in classes:
        assert got[c] == pytest.approx(want[c])
    macro = metrics.macro_weighted_averages(counts_of(spark, gold, pred), ["grp"], grid, declared).first()
    assert macro["macro_f1"] == pytest.approx(sum(v[2] for v in want.values()) / len(want))
    support = sum(v[3] for v in want.values())
    assert macro["weighted_recall"] == pytest.approx(sum(v[1] * v[3] for v in want.values()) / support)
    assert macro["accuracy"] == pytest.approx(sum(a == b for a, b in zip(gold, pred)) / len(gold))


def test_report_rows(spark, sample):
    gold, pred = sample
    counts = counts_of(spark, gold, pred)
    report = {r["label"]: r for r in metrics.classification_report(counts, ["grp"]).collect()}
    assert set(report) == {"belief", "fact-check", "other", "political", "accuracy", "macro avg", "weighted avg"}
    assert report["accuracy"]["precision"] is None and report["accuracy"]["support"] == len(gold)
    assert report["political"]["recall"] == 0.0 and report["political"]["support"] == 0
    acc = metrics.accuracy(counts, ["grp"]).first()
    assert acc["accuracy"] == pytest.approx(report["accuracy"]["f1"])
    # Accuracy is the support-weighted recall.
    assert report["weighted avg"]["recall"] == pytest.approx(acc["accuracy"])


def test_matrix_grids(spark, sample):
    gold, pred = sample
    counts = counts_of(spark, gold, pred)
    by_gold = metrics.confusion_matrix(counts, ["grp"], "gold")
    union = metrics.confusion_matrix(counts, ["grp"], "union")
    assert by_gold.count() == 9 and union.count() == 16
    assert union.agg(F.sum("n")).first()[0] == len(gold)
    # Predictions outside the gold classes drop out of the gold grid only.
    assert by_gold.agg(F.sum("n")).first()[0] == len(gold) - pred.count("political")
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in union.collect()}
    assert all(cells[(a, b)] == sum(x == a and y == b for x, y in zip(gold, pred)) for a, b in cells)
    wide = metrics.confusion_matrix_wide(counts, ["belief", "never"], ["grp"])
    assert rows(wide.select("true_label", "belief", "never"), "true_label") == [
        ("belief", cells[("belief", "belief")], 0), ("never", 0, 0),
    ]
    shares = metrics.confusion_matrix_normalized(counts, ["grp"], "union")
    sums = {r[0]: r[1] for r in shares.groupBy("true_label").agg(F.round(F.sum("share"), 9)).collect()}
    assert sums == {"belief": 1.0, "fact-check": 1.0, "other": 1.0, "political": 0.0}


def test_one_vs_rest_adds_up(spark, sample):
    gold, pred = sample
    n = len(gold)
    table = metrics.one_vs_rest_metrics(
        counts_of(spark, gold, pred), ["grp"], "declared", ["belief", "fact-check", "other", "never"]
    )
    for r in table.collect():
        c = r["class"]
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == n
        assert r["tp"] == sum(a == c == b for a, b in zip(gold, pred))
        assert r["fp"] == sum(a != c and b == c for a, b in zip(gold, pred))
        negatives = r["tn"] + r["fp"]
        assert r["specificity"] == pytest.approx(r["tn"] / negatives if negatives else 0.0)
    cells = metrics.binary_cells(table, ["grp"])
    assert cells.count() == 16 and cells.agg(F.sum("value")).first()[0] == 4 * n


def test_groups_are_independent(spark, sample):
    gold, pred = sample
    half = ["a" if i % 2 else "b" for i in range(len(gold))]
    both = metrics.per_class_metrics(counts_of(spark, gold, pred, half), ["grp"], "union")
    for name in "ab":
        g = [x for x, h in zip(gold, half) if h == name]
        p = [x for x, h in zip(pred, half) if h == name]
        want = class_table(g, p, sorted(set(g) | set(p)))
        got = {r["label"]: r["f1"] for r in both.filter(F.col("grp") == name).collect()}
        assert got == pytest.approx({c: v[2] for c, v in want.items()})


def test_null_prediction_is_an_error(spark):
    counts = counts_of(spark, ["a", "a", "b"], ["a", None, "b"])
    assert metrics.accuracy(counts, ["grp"]).first()["accuracy"] == pytest.approx(2 / 3)
    got = {r["label"]: r["recall"] for r in metrics.per_class_metrics(counts, ["grp"], "union").collect()}
    assert got == {"a": 0.5, "b": 1.0}
    matrix = metrics.confusion_matrix(counts, ["grp"], "union").collect()
    assert sum(r["n"] for r in matrix) == 2


def test_one_class_and_empty_input(spark):
    one = metrics.classification_report(counts_of(spark, ["a", "a"], ["a", "a"]), ["grp"])
    assert {r["label"]: r["f1"] for r in one.collect()} == {
        "a": 1.0, "accuracy": 1.0, "macro avg": 1.0, "weighted avg": 1.0
    }
    empty = counts_of(spark, ["a"], ["a"]).limit(0)
    assert metrics.classification_report(empty, ["grp"]).collect() == []
    assert metrics.confusion_matrix(empty, ["grp"]).collect() == []


def test_without_groups(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "gold string, pred string")
    counts = metrics.confusion_counts(df)
    assert metrics.accuracy(counts).first()["accuracy"] == 0.5
    assert rows(metrics.confusion_matrix(counts), "true_label", "pred_label") == [
        ("a", "a", 1), ("a", "b", 0), ("b", "a", 1), ("b", "b", 0)
    ]
    assert metrics.per_class_metrics(counts).count() == 2


def test_grid_arguments(spark):
    counts = counts_of(spark, ["a"], ["a"])
    for bad in ({"grid": "nope"}, {"grid": "declared"}, {"grid": "gold", "classes": ["a"]}):
        with pytest.raises(ValueError):
            metrics.per_class_metrics(counts, ["grp"], **bad)


def test_fold_summary(spark):
    data = [("e", "m", "n", 1, "acc", 0.5), ("e", "m", "n", 2, "acc", 0.7), ("e", "m", "n", 1, "one", 3.0)]
    df = spark.createDataFrame(
        data, "experiment_name string, model_key string, model_name string, fold int, metric string, value double"
    )
    got = {r["metric"]: (r["mean"], r["std"]) for r in metrics.fold_summary(df).collect()}
    assert got["acc"] == pytest.approx((0.6, 0.02**0.5)) and got["one"] == (3.0, 0.0)


def test_error_analysis_orders_and_stops(spark):
    df = spark.range(200).select("id", F.lit("a").alias("gold"), F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("pred"))
    got = [r["id"] for r in metrics.error_analysis(df, ["id"]).collect()]
    assert got == list(range(0, 100, 2))


def test_metric_names(spark):
    assert spark.range(1).select(metrics.metric_name(F.lit("test_a_test_b"))).first()[0] == "a_b"
    report = metrics.classification_report(counts_of(spark, ["fact-check"], ["fact-check"]), ["grp"])
    names = {r["metric"] for r in metrics.metric_rows(report, ["grp"]).collect()}
    assert names == {
        "fact_check_precision", "fact_check_recall", "fact_check_f1", "fact_check_support",
        "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1",
    }


def test_a_class_wins_the_name_of_an_average(spark):
    report = metrics.classification_report(counts_of(spark, ["macro", "test_x"], ["macro", "macro"]), ["grp"], "union")
    got = [(r["metric"], r["value"]) for r in metrics.metric_rows(report, ["grp"]).collect()]
    assert len(dict(got)) == len(got)
    assert dict(got)["macro_recall"] == 1.0 and dict(got)["test_x_recall"] == 0.0 and dict(got)["accuracy"] == 0.5


def test_rows_without_a_true_label_are_no_hits(spark):
    df = spark.createDataFrame([(None, None), ("a", "a"), ("a", "b")], "gold string, pred string")
    counts = metrics.confusion_counts(df, "gold", "pred")
    assert metrics.accuracy(counts).first().accuracy == 0.5
    assert rows(metrics.per_class_metrics(counts).select("label", "support")) == [("a", 2)]
