from __future__ import annotations

import random

from tests.helpers import rows
from threadlab.operators import history


def brute(values, patience):
    best, stale = None, 0
    for i, v in enumerate(values):
        stale = 0 if best is None or v > best else stale + 1
        best = v if best is None else max(best, v)
        if stale >= patience:
            return i + 1
    return len(values)


def test_early_stopping_rule(spark):
    rng = random.Random(3)
    runs = {r: [round(rng.random(), 1) for _ in range(rng.randint(1, 10))] for r in range(120)}
    data = [(r, e + 1, v) for r, vs in runs.items() for e, v in enumerate(vs)]
    df = spark.createDataFrame(data, "run long, epoch int, eval_metric double")
    for patience in (1, 2, 3):
        got = {r["run"]: r for r in history.early_stopping(df, patience).collect()}
        for run, values in runs.items():
            stop = brute(values, patience)
            assert got[run]["stop_epoch"] == stop
            seen = values[:stop]
            assert got[run]["best_metric"] == max(seen)
            assert got[run]["best_epoch"] == seen.index(max(seen)) + 1
            # The rule used inside a running training says the same.
            live = next((i for i in range(1, len(values) + 1) if history.should_stop(values[:i], patience)), len(values))
            assert live == stop


def test_learning_curve_drops_blanks(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.5, None), (1, 2, None, 0.25)], "run int, epoch int, loss double, eval_metric double"
    )
    assert rows(history.learning_curve(df), "epoch") == [(1, 1, "loss", 0.5), (1, 2, "eval_metric", 0.25)]
