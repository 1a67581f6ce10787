from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlab.functions.registry import COARSE_LABELS, LABEL_MAP
from threadlab.operators import pairs, scoring
from threadlab.operators.training import TrainConfig
from threadlab.plans import zero_shot

LABELS = ["belief", "fact-check", "other"]
TERMS = {"belief": "truth hidden elites", "fact-check": "source false debunked", "other": "cat nice weather"}


@pytest.fixture(scope="module")
def gold(spark):
    data = [(i, f"{TERMS[LABELS[i % 3]]} word{i % 7} more", LABELS[i % 3]) for i in range(150)]
    return spark.createDataFrame(data, "id long, comment string, label string").cache()


def test_batches_keep_the_budget():
    sizes = [3, 50, 1, 7, 7, 200, 4, 50]
    made = list(pairs.filled_batches(sizes, 100))
    assert sorted(i for b in made for i in b) == list(range(8))
    assert all(len(b) == 1 or max(sizes[i] for i in b) * len(b) <= 100 for b in made)
    assert list(pairs.filled_batches([], 5)) == []


def test_a_trained_model_labels_comments(spark, gold):
    model = pairs.train_pairs(gold, LABELS, TrainConfig(n_features=512, epochs=8, batch_size=64, learning_rate=0.1))
    statements = pairs.hypotheses(LABELS)
    new = spark.createDataFrame(
        [(1, "hidden truth again here"), (2, "this source was debunked"), (3, "what nice weather today"), (4, "[removed]"), (5, None), (6, "two words")],
        "id long, comment string",
    )
    got = {}
    for budget in (4, 10_000):  # batch size and order do not matter
        for rows in (new, new.orderBy(F.desc("id")).repartition(3)):
            scorer = pairs.pair_scorer(lambda: model, statements, budget)
            made = scoring.zero_shot(rows, LABELS, scorer, {}).collect()
            found = {r.id: (r.pred_label, round(r.pred_score, 12)) for r in made}
            assert not got or found == got
            got = found
    assert [got[i][0] for i in (1, 2, 3)] == LABELS and all(got[i] == ("other", 1.0) for i in (4, 5, 6))
    one = model([("hidden truth again here", s) for s in statements])
    many = model([("hidden truth again here", s) for s in statements] * 300 + [("x " * 400, statements[0])])
    assert np.allclose(many[:3], one) and np.allclose(many[897:900], one)


def test_candidates_learn_from_the_gold_labels_they_map_to(spark, gold):
    cfg = TrainConfig(n_features=512, epochs=8, batch_size=64, learning_rate=0.1)
    spelt = gold.withColumn("label", F.when(F.col("id") % 2 == 0, F.upper("label")).otherwise(F.col("label")))
    several = ("outrage", "meta", "skepticism", "endorse")
    for names, mapping in ((COARSE_LABELS, LABEL_MAP), (several, LABEL_MAP), (("x", "y", "z"), dict(zip("xyz", LABELS, strict=True)))):
        model = pairs.train_pairs(spelt, names, cfg, mapping=mapping)
        for label in LABELS:
            logits = model([(TERMS[label], s) for s in pairs.hypotheses(names)])
            assert [z > 0 for z in logits] == [mapping[name] == label for name in names]
    model = pairs.train_pairs(spelt, COARSE_LABELS, cfg)
    scorer = pairs.pair_scorer(lambda: model, pairs.hypotheses(COARSE_LABELS))
    labelled = zero_shot.label_gold(spelt.withColumn("topic", F.lit("t")), scorer)
    assert labelled.where("assigned_label = pred_label_mapped").count() == 150


def test_equal_comments_are_scored_once_and_masked_rows_never(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        def model(batch):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write("\n".join(t for t, _ in batch))
            return [float(len(t)) for t, _ in batch]

        return model

    rows = [(i, "the same long comment") for i in range(50)] + [(100, "another long comment"), (101, None), (102, "[deleted]"), (103, "no")]
    df = spark.createDataFrame(rows, "id long, comment string").repartition(5)
    made = scoring.zero_shot(df, LABELS, pairs.pair_scorer(load, ["a", "b", "c"]), {}).collect()
    assert len(made) == 54
    seen = [line for p in tmp_path.iterdir() for line in p.read_text().split("\n")]
    assert sorted(seen) == ["another long comment"] * 3 + ["the same long comment"] * 3


def test_statements_and_empty_tables(spark, gold):
    assert pairs.hypotheses(["x"], "It is {}") == ["It is x"]
    scorer = pairs.pair_scorer(lambda: None, ["a"])
    assert scoring.zero_shot(gold.limit(0), ["l"], scorer, {}).count() == 0
