from __future__ import annotations

import numpy as np
import pytest

from tests.helpers import rows
from threadlab.functions.registry import COARSE_LABELS, FINE_LABELS, LABEL_MAP, Topic, topics_frame
from threadlab.operators import labels, scoring

GOLD = "id long, comment string, topic string, label string"


def test_invalid_comments_get_the_default(spark):
    data = [(1, None, "t", "x"), (2, "[Removed]", "t", "x"), (3, "bad bad", "t", "x"), (4, "bad bad day", "t", "x"),
            (5, "nothing to see here", "t", "x")]
    df = spark.createDataFrame(data, GOLD)
    scorer = scoring.lexicon_scorer(["spreads misinformation", "meta"], {"spreads misinformation": ["bad"]}, {"meta": 0.5})
    got = {r["id"]: r for r in scoring.zero_shot(df, ["spreads misinformation", "meta"], scorer, LABEL_MAP).collect()}
    for i in (1, 2, 3):
        assert (got[i]["pred_label"], got[i]["pred_label_mapped"], got[i]["pred_score"]) == ("other", "other", 1.0)
    assert (got[4]["pred_label"], got[4]["pred_label_mapped"]) == ("spreads misinformation", "belief")
    assert got[4]["pred_score"] == pytest.approx(1 / (1 + np.exp(-1.5)))
    assert got[5]["pred_label_mapped"] == "other"


def test_model_never_sees_invalid_text(spark):
    def load():
        def model(texts):
            assert all(len(t.split()) >= 3 for t in texts)
            return [[1.0, 1.0] for _ in texts]

        return model

    data = [(i, "a b c" if i % 2 else "[deleted]", "t", "x") for i in range(40)]
    df = spark.createDataFrame(data, GOLD).repartition(4)
    out = scoring.zero_shot(df, ["first", "second"], scoring.model_scorer(load, 2), {})
    got = {r["id"]: (r["pred_label"], r["pred_score"]) for r in out.collect()}
    # A tie goes to the first candidate.
    assert all(got[i] == (("first", 0.5) if i % 2 else ("other", 1.0)) for i in range(40))


def test_argmax_and_ranking_break_ties_by_position(spark):
    data = [(1, 0, "a", 0.5), (1, 1, "b", 0.5), (1, 2, "c", 0.1), (2, 0, "a", 0.1), (2, 1, "b", 0.3), (2, 2, "c", 0.3)]
    df = spark.createDataFrame(data, "id long, pos int, label string, score double")
    assert rows(scoring.argmax_label(df), "id") == [(1, "a", 0.5), (2, "b", 0.3)]
    ranked = scoring.label_ranking(df).filter("rank = 1").select("id", "label")
    assert rows(ranked, "id") == [(1, "a"), (2, "b")]


def test_prototypes(spark):
    data = [(1, [1.0, 0.0], 0), (2, [0.8, 0.2], 0), (3, [0.0, 2.0], 1), (4, None, 1)]
    df = spark.createDataFrame(data, "id long, embedding array<float>, label int")
    matrix = scoring.collect_prototypes(scoring.label_prototypes(df.dropna(), 2), [0, 1])
    assert matrix == pytest.approx(np.array([[0.9, 0.1], [0.0, 2.0]]))
    scored = scoring.prototype_scorer(matrix)(df, "embedding", "s").orderBy("id").collect()
    assert [int(np.argmax(r["s"])) for r in scored[:3]] == [0, 0, 1]
    assert scored[2]["s"][1] == pytest.approx(1.0) and scored[3]["s"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        scoring.collect_prototypes(scoring.label_prototypes(df.dropna(), 2), [0, 5])


def test_map_labels_dict_table_and_pass_through(spark):
    df = spark.createDataFrame([(1, "outrage"), (2, "political"), (3, None), (4, "Outrage")], "id long, pred_label string")
    want = [(1, "belief"), (2, "political"), (3, None), (4, "Outrage")]
    assert rows(labels.map_labels(df, LABEL_MAP).select("id", "pred_label_mapped"), "id") == want
    table = spark.createDataFrame(list(LABEL_MAP.items()), "label string, mapped string")
    assert rows(labels.map_labels(df, table).select("id", "pred_label_mapped"), "id") == want
    assert rows(labels.map_labels(df, {}).select("id", "pred_label_mapped"), "id")[0] == (1, "outrage")


def test_encode_labels(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id long, label string")
    classes = labels.class_index(df)
    assert rows(labels.encode_labels(df, classes), "id") == [(1, "b", 1), (2, "a", 0), (3, "b", 1)]
    stranger = spark.createDataFrame([(1, "zzz")], "id long, label string")
    with pytest.raises(Exception, match="unknown label: zzz"):
        labels.encode_labels(stranger, classes).collect()


def test_prepare_gold(spark):
    data = [(1, "x", " EN\t", "Fact check"), (2, None, "en", "b"), (3, "y", "de", None), (4, "z", "fr", "b")]
    df = spark.createDataFrame(data, GOLD)
    got = labels.prepare_gold(df, topics=["en", "de"])
    assert rows(got, "id") == [(1, "x", "en", "fact-check")]
    assert labels.missing_topics(got, ["en", "de"]) == ["de"]
    with pytest.raises(ValueError, match="nope"):
        labels.require_columns(df, ["id", "nope"])


def test_registry(spark):
    assert len(LABEL_MAP) == 14 and "political" not in LABEL_MAP
    frame = topics_frame(spark, [Topic(name, labels=own) for name, own in FINE_LABELS.items()])
    got = {r["topic"]: r["label_set"] for r in frame.collect()}
    assert got == {k: list(v) for k, v in FINE_LABELS.items()}
    assert tuple(Topic("health").labels) == COARSE_LABELS
