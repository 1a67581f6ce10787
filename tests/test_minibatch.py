from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlab.operators import metrics, minibatch
from threadlab.operators.training import TrainConfig, evaluate
from threadlab.plans import experiments
from threadlab.plans.experiments import ExperimentConfig, run_cv

CLASSES = ["belief", "fact-check", "other"]


@pytest.fixture(scope="module")
def gold(spark):
    terms = {"belief": "truth hidden elites", "fact-check": "source false debunked", "other": "cat nice weather"}
    data = [(i, f"{terms[CLASSES[i % 3]]} word{i % 5} more", "en" if i % 2 else "de", CLASSES[i % 3]) for i in range(120)]
    return spark.createDataFrame(data, "id long, comment string, topic string, label string").cache()


@pytest.mark.parametrize("layers", [(7, 3), (7, 5, 3), (7, 4, 4, 2)])
def test_gradient_equals_finite_differences(layers):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=sum(a * b + b for a, b in zip(layers, layers[1:])))
    counts, idf = rng.integers(0, 4, (11, layers[0])).astype(float), rng.random(layers[0]) + 0.2
    labels = rng.integers(0, layers[-1], 11)
    loss, gradient = minibatch.loss_and_gradient(weights, layers, counts, idf, labels)
    for k in rng.choice(len(weights), 25):
        moved = [weights.copy(), weights.copy()]
        moved[0][k] += 1e-6
        moved[1][k] -= 1e-6
        up, down = (minibatch.loss_and_gradient(w, layers, counts, idf, labels)[0] for w in moved)
        assert gradient[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)
    assert loss > 0


def test_rate_falls_and_decay_is_decoupled():
    plain, decayed = (minibatch.Adam(np.ones(3), 0.1, d, 4) for d in (0.0, 0.5))
    rates = [plain.step(np.zeros(3)) for _ in range(4)]
    assert rates == pytest.approx([0.1, 0.075, 0.05, 0.025]) and plain.now() == 0 and (plain.weights == 1).all()
    decayed.step(np.zeros(3))
    assert decayed.weights == pytest.approx(np.full(3, 0.95))  # no gradient, yet smaller
    one = minibatch.Adam(np.zeros(2), 0.1, 0.0, 10)
    one.step(np.array([5.0, -0.001]))
    assert one.weights == pytest.approx([-0.1, 0.1], rel=1e-4)  # a first step has the size of the rate
    kept = one.first.copy()
    one.step(np.zeros(2))
    assert one.first == pytest.approx(0.9 * kept)


def test_word_counts_of_sliced_lists():
    slots = pa.array([[1, 1], [0], [], [2, 0, 2, 2]]).slice(1)
    assert minibatch.word_counts(slots, np.array([2, 0, 1]), 3).tolist() == [[1, 0, 3], [1, 0, 0], [0, 0, 0]]


def test_figures_from_counts_equal_those_from_rows(spark):
    data = [("belief", "other")] * 3 + [("fact-check", "fact-check")] * 4 + [("other", "belief")] + [("other", "other")] * 5
    df = spark.createDataFrame(data, "gold_label string, predicted_label string")
    names = [*CLASSES, "never seen"]
    matrix = np.zeros((4, 4))
    for g, p in data:
        matrix[names.index(g), names.index(p)] += 1
    assert minibatch.scores_of(matrix, names) == pytest.approx(evaluate(df, names))
    assert set(minibatch.scores_of(np.zeros((3, 3)), CLASSES).values()) == {0.0}


def _table(gold, cfg):
    data, _ = experiments.prepare_folds(gold, cfg)
    return data.withColumn("val_mask", minibatch.fold_mask("val_runs"))


def test_runs_trained_together_equal_single_ones(spark, gold):
    cfg = ExperimentConfig(topics=["en"], n_splits=3, train=TrainConfig(n_features=64, epochs=3, batch_size=16))
    rows = _table(gold, cfg)
    classes = {"ul_all_topics": CLASSES, "ul_en": CLASSES}
    runs = [
        minibatch.Run(e, m, f, (64, *hidden, 3), 42 + f)
        for e in classes for m, hidden in (("softmax", ()), ("hidden", (5,))) for f in (1, 2, 3)
    ]
    together = minibatch.train(rows, runs, classes, cfg.train, "id", 42)
    for k in (0, 4, 8, 11):
        (single,) = minibatch.train(rows, [runs[k]], {runs[k].experiment: CLASSES}, cfg.train, "id", 42)
        assert np.allclose(single.weights, together[k].weights, atol=1e-9) and single.best_epoch == together[k].best_epoch
        assert [h.get("eval_macro_f1") for h in single.history] == [h.get("eval_macro_f1") for h in together[k].history]
    steps = [h for h in together[0].history if "step" in h]
    rates = [h["learning_rate"] for h in steps]
    assert rates[0] == cfg.train.learning_rate and rates == sorted(rates, reverse=True) and len(set(rates)) == len(rates)
    assert len({h["step"] for h in steps}) == -(-68 // 16)  # 80 rows outside a fold less 12 of validation


def test_a_step_is_the_mean_over_the_rows_of_the_batch(spark, gold):
    """One full batch against the same figures without Spark."""
    cfg = ExperimentConfig(topics=[], run_per_topic=False, n_splits=3, train=TrainConfig(n_features=32, epochs=1, batch_size=10_000))
    rows = _table(gold, cfg)
    run = minibatch.Run("ul_all_topics", "softmax", 2, (32, 3), 1)
    (fitted,) = minibatch.train(rows, [run], {"ul_all_topics": CLASSES}, cfg.train, "id", 42)
    mine = [r for r in rows.collect() if r.fold != 2 and not r.val_mask >> 2 & 1]
    counts = np.array([np.bincount(r.slots, minlength=32) for r in mine], float)
    idf = np.log((len(mine) + 1) / ((counts > 0).sum(axis=0) + 1))
    labels = np.array([r.label_id for r in mine])
    _, gradient = minibatch.loss_and_gradient(np.zeros(32 * 3 + 3), (32, 3), counts, idf, labels)
    adam = minibatch.Adam(np.zeros(32 * 3 + 3), cfg.train.learning_rate, cfg.train.weight_decay, 1)
    adam.step(gradient / len(mine))
    assert np.allclose(fitted.idf, idf) and np.allclose(fitted.weights, adam.weights, atol=1e-9)


def test_many_parts_are_added_in_a_tree(spark, gold):
    cfg = ExperimentConfig(topics=[], run_per_topic=False, n_splits=2, train=TrainConfig(n_features=16))
    rows = _table(gold, cfg).repartition(40)
    runs = [minibatch.Run("ul_all_topics", "softmax", f, (16, 3), 1) for f in (1, 2)]

    def total(_, counts, labels):
        return np.concatenate([[len(labels)], counts.sum(axis=0)])

    tree = minibatch.summed(rows, runs, minibatch.train_rows, total, 8, 40)
    flat = minibatch.summed(rows, runs, minibatch.train_rows, total, 8, 1)
    assert {k: v.tolist() for k, v in tree.items()} == {k: v.tolist() for k, v in flat.items()} and len(tree) == 2


def test_slow_models_show_in_the_seconds(spark, gold, monkeypatch):
    """Only time inside the model counts, not planning and writing."""
    cfg = ExperimentConfig(topics=[], run_per_topic=False, n_splits=2, models={"softmax": "s"}, train=TrainConfig(n_features=16, epochs=1))
    result = run_cv(gold, cfg)
    assert 0 < result.totals["seconds"] < 2 and result.totals["rows"] == 120
    by_run = result.fold_metrics.filter("metric = 'avg_inference_time_sec'").collect()
    assert len(by_run) == 2 and sum(r["value"] * 60 for r in by_run) == pytest.approx(result.totals["seconds"], rel=1e-6)
    errors = metrics.misclassified(result.predictions, "gold_label", "predicted_label").count()
    assert result.totals["errors"] == errors


def test_rows_without_a_true_label_are_no_errors(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "gold string, pred string")
    assert metrics.misclassified(df).count() == 1


def test_empty_and_null_texts_are_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b a")], "id long, t string")
    slots = {r.id: r.s for r in df.select("id", minibatch.hashed_words("t", 2, 8).alias("s")).collect()}
    assert slots[1] == slots[2] == [] and len(slots[3]) == 2
    masks = df.select(minibatch.fold_mask(F.array(F.lit(1), F.lit(5))).alias("m")).first().m
    assert masks == 0b100010


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_more_steps_are_no_more_jobs(spark, gold):
    """What the driver sees does not grow with the number of steps."""
    jobs, steps = [], []
    for size in (4, 1000):
        cfg = ExperimentConfig(topics=[], run_per_topic=False, n_splits=2, train=TrainConfig(n_features=16, epochs=1, batch_size=size))
        run = minibatch.Run("ul_all_topics", "softmax", 1, (16, 3), 1)
        rows = _table(gold, cfg)
        (fitted,), n = _jobs(spark, f"steps-{size}", lambda: minibatch.train(rows, [run], {"ul_all_topics": CLASSES}, cfg.train, "id", 42))
        jobs.append(n)
        steps.append(len(fitted.steps[0]))
    assert steps[0] > 10 * steps[1] and jobs[0] <= jobs[1] + 2


def test_portions_and_large_batches_give_the_same_weights(spark, gold, monkeypatch):
    cfg = ExperimentConfig(topics=["en"], n_splits=2, train=TrainConfig(n_features=32, epochs=2, batch_size=8))
    rows = _table(gold, cfg)
    runs = [minibatch.Run(e, "hidden", f, (32, 4, 3), 7) for e in ("ul_all_topics", "ul_en") for f in (1, 2)]
    classes = {"ul_all_topics": CLASSES, "ul_en": CLASSES}
    found = []
    for portion in (1 << 17, 24, 1):  # one portion, several, and each batch larger than a portion
        monkeypatch.setattr(minibatch, "PORTION", portion)
        found.append(minibatch.train(rows, runs, classes, cfg.train, "id", 42))
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert np.allclose(a.weights, b.weights, atol=1e-9) and a.best_epoch == b.best_epoch
            assert [h.keys() for h in a.history] == [h.keys() for h in b.history]
            assert all(h == pytest.approx(g) for h, g in zip(a.history, b.history, strict=True))


def test_words_of_wide_rows_multiply_like_their_counts():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 5000, n).tolist() + [7] * (n % 3) for n in (4, 0, 9, 30)]
    slots, rows, mask = pa.array(lists, pa.list_(pa.int32())), np.array([3, 1, 0, 2]), np.array([True, False, True, True])
    dense, words = minibatch.word_counts(slots, rows, 5000), minibatch.words_of(slots, rows, 5000)
    right, left = rng.normal(size=(5000, 3)), rng.normal(size=(4, 3))
    assert isinstance(words, minibatch.WordRows) and np.allclose(words @ right, dense @ right) and np.allclose(words.T @ left, dense.T @ left)
    assert np.allclose(words[mask] @ right, dense[mask] @ right) and (words.rows_with() == (dense > 0).sum(axis=0)).all()
