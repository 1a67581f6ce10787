from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadlab.operators import history, metrics
from threadlab.operators.training import TrainConfig, evaluate, term_frequencies
from threadlab.plans.experiments import ExperimentConfig, run_config, run_cv, run_experiments, run_topic
from threadlab.sources import writers

CLASSES = ["belief", "fact-check", "other"]
TINY = TrainConfig(n_features=64, epochs=4, steps_per_epoch=4)


@pytest.fixture(scope="module")
def gold(spark):
    terms = {"belief": "truth hidden elites", "fact-check": "source false debunked", "other": "cat nice weather"}
    data = []
    for i in range(90):
        label = CLASSES[i % 3]
        data.append((i, f"{terms[label]} word{i % 5} more", "en" if i % 2 else "de", label))
    return spark.createDataFrame(data, "id long, comment string, topic string, label string").cache()


def test_truncation(spark):
    df = spark.createDataFrame([("a b c d e",)], "t string")
    tf = term_frequencies(df, "t", 3, 32).first()["tf"]
    assert sum(tf.values) == 3.0


def test_driver_figures_equal_the_report(spark):
    data = [("belief", "other")] * 3 + [("fact-check", "fact-check")] * 4 + [("other", "belief")] + [("other", "other")] * 5
    df = spark.createDataFrame(data, "gold_label string, predicted_label string")
    counts = metrics.confusion_counts(df, "gold_label", "predicted_label")
    report = metrics.classification_report(counts, grid="union")
    want = {r["metric"]: r["value"] for r in metrics.metric_rows(report, []).collect()}
    assert evaluate(df, CLASSES) == pytest.approx(want)
    # A declared class without rows has its own lines and leaves the averages alone.
    absent = {f"never_seen_{m}": 0.0 for m in ("precision", "recall", "f1", "support")}
    assert evaluate(df, [*CLASSES, "never seen"]) == pytest.approx({**want, **absent})
    assert set(evaluate(df.limit(0), CLASSES).values()) == {0.0}


def test_weight_decay_shrinks_the_weights(spark, gold):
    def size(decay):
        cfg = ExperimentConfig(train=TrainConfig(n_features=64, epochs=3, batch_size=8, weight_decay=decay))
        rows = run_topic(gold, "en", cfg).history.filter("key = 'loss' AND epoch = 2").collect()
        return rows[0]["value"]

    assert size(0.5) > size(0.0)


def test_cross_validation(spark, gold, tmp_path):
    cfg = ExperimentConfig(topics=["en"], n_splits=2, train=TINY, models={"softmax": "s", "logreg": "l"})
    result = run_experiments(gold, cfg, str(tmp_path / "cv"), "gold.csv")
    folds = result.fold_metrics
    runs = folds.select("experiment_name", "model_key", "fold").distinct()
    assert runs.count() == 2 * 2 * 2
    sizes = {
        (r["experiment_name"], r["metric"]): r["v"]
        for r in folds.filter(F.col("metric").startswith("n_") & (F.col("model_key") == "softmax"))
        .groupBy("experiment_name", "metric").agg(F.sum("value").alias("v")).collect()
    }
    assert sizes[("ul_all_topics", "n_test")] == 90 and sizes[("ul_en", "n_test")] == 45
    assert sizes[("ul_all_topics", "n_train")] + sizes[("ul_all_topics", "n_val")] == 90
    # Every row of an experiment is predicted once per model; both models share the folds.
    by_model = result.predictions.groupBy("experiment_name", "id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("folds")
    )
    assert by_model.filter("n <> 2 OR folds <> 1").count() == 0
    f1 = result.summary.filter("metric = 'macro_f1' AND model_key = 'logreg'").collect()
    assert all(r["mean"] > 0.8 for r in f1)
    assert result.summary.filter("metric = 'avg_inference_time_sec'").count() == 4
    (out,) = (tmp_path / "cv").glob("run_ts=*")
    config = spark.read.json(str(tmp_path / "cv" / "run_config")).first()
    assert config.n_splits == 2 and config.output_path == str(tmp_path / "cv") and config.data_path == "gold.csv"
    assert result.totals["rows"] == result.predictions.count() == 2 * 135
    assert result.totals["errors"] == metrics.misclassified(result.predictions, "gold_label", "predicted_label").count()
    assert result.totals["seconds"] > 0
    summary = spark.read.option("header", True).csv(str(out / "summary_metrics"))
    assert summary.count() == 4 and "macro_f1_mean" in summary.columns and "macro_f1_std" in summary.columns


def test_topic_workflow(spark, gold, tmp_path):
    result = run_topic(gold, "en", ExperimentConfig(train=TINY))
    assert set(result.test) >= {"accuracy", "macro_f1", "weighted_f1", "fact_check_f1"}
    assert result.predictions.count() == 7
    assert result.n_errors == metrics.misclassified(result.predictions, "gold_label", "predicted_label").count()
    assert result.matrix.count() == 9 and result.one_vs_rest.count() == 3
    lines = result.history.filter("key = 'eval_macro_f1'").select("fold", "epoch", "value")
    stopped = history.early_stopping(lines, TINY.patience, ["fold"], "epoch", "value").first()
    assert stopped["stop_epoch"] == lines.count()
    losses = [r["value"] for r in result.history.filter("key = 'loss'").orderBy("epoch").collect()]
    assert losses == sorted(losses, reverse=True)
    writers.write_workflow(result, spark, str(tmp_path / "wf"))
    matrix = spark.read.option("header", True).csv(str(tmp_path / "wf" / "confusion_matrix_normalized"))
    assert matrix.columns == ["true_label", *CLASSES] and matrix.count() == 3
    written = {p.name for p in (tmp_path / "wf").iterdir()}
    assert {"training_history", "validation_metrics", "test_metrics", "error_analysis"} <= written


def test_configuration_checks(spark, gold):
    with pytest.raises(ValueError):
        run_cv(gold, ExperimentConfig(run_pooled=False, run_per_topic=False))
    with pytest.raises(ValueError, match="unknown models"):
        run_cv(gold, ExperimentConfig(models={"nope": "x"}))
    with pytest.raises(ValueError, match="fewer than 40 rows"):
        run_cv(gold, ExperimentConfig(n_splits=40))
    row = run_config(spark, ExperimentConfig(train=TINY)).first()
    assert (row.n_splits, row.seed, row.val_size, row.patience) == (5, 42, 0.15, 2)
