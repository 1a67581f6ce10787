from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import kfold_sizes, rows
from threadlab.operators import splits


def labelled(spark, sizes, topic="t"):
    data, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            data.append((i, label, topic))
            i += 1
    return spark.createDataFrame(data, "id long, label string, topic string")


SIZES = {"belief": 33, "fact-check": 17, "other": 301}


def test_kfold_sizes_and_order(spark):
    df = labelled(spark, SIZES)
    got = splits.stratified_kfold(df, 5, 42).collect()
    labels = [r["label"] for r in got]
    assert len({r["id"] for r in got}) == sum(SIZES.values())
    assert Counter((r["label"], r["fold"]) for r in got) == kfold_sizes(labels, 5)
    ordered = sorted(got, key=lambda r: (r["label"], hashlib.md5(f"42:{r['id']}".encode()).hexdigest(), r["id"]))
    assert [r["fold"] for r in ordered] == [i % 5 + 1 for i in range(len(ordered))]


def test_kfold_does_not_depend_on_partitions(spark):
    df = labelled(spark, SIZES)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(rows(splits.stratified_kfold(df.repartition(int(n)), 5, 7).select("id", "fold"), "id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    assert seen[0] != rows(splits.stratified_kfold(df, 5, 8).select("id", "fold"), "id")


def test_grouped_kfold_equals_separate_runs(spark):
    a, b = labelled(spark, {"x": 12, "y": 8}, "a"), labelled(spark, {"x": 5, "z": 9}, "b")
    together = splits.stratified_kfold(a.unionByName(b), 5, 42, group=["topic"])
    for name, part in (("a", a), ("b", b)):
        want = rows(splits.stratified_kfold(part, 5, 42).select("id", "fold"), "id")
        assert rows(together.filter(F.col("topic") == name).select("id", "fold"), "id") == want


@pytest.mark.parametrize("size", [0.15, 0.3, 0.5])
def test_split_sizes(spark, size):
    got = splits.stratified_split(labelled(spark, SIZES), size, 42).collect()
    n = len(got)
    n_test = math.ceil(size * n)
    assert Counter(r["role"] for r in got) == {"test": n_test, "train": n - n_test}
    for label, count in SIZES.items():
        kept = sum(r["role"] == "train" and r["label"] == label for r in got)
        assert abs(kept - count * (n - n_test) / n) < 1


def test_train_val_test_equals_two_splits(spark):
    df = labelled(spark, SIZES)
    once = splits.train_val_test_split(df, 0.3, 0.5, 42)
    first = splits.stratified_split(df, 0.3, 42, names=("train", "held"))
    held = first.filter("role = 'held'").drop("role")
    second = splits.stratified_split(held, 0.5, 42, names=("val", "test"))
    want = first.filter("role = 'train'").unionByName(second)
    assert rows(once.select("id", "role"), "id") == rows(want.select("id", "role"), "id")
    assert Counter(r["role"] for r in once.collect()) == {"train": 245, "val": 53, "test": 53}


def test_split_refuses_tiny_classes(spark):
    with pytest.raises(Exception, match="fewer than 2 rows"):
        splits.stratified_split(labelled(spark, {"a": 1, "b": 20}), 0.3).collect()
    with pytest.raises(Exception, match="fewer rows than classes"):
        splits.stratified_split(labelled(spark, {"a": 2, "b": 2, "c": 2}), 0.15).collect()
    assert splits.stratified_split(labelled(spark, {"a": 1, "b": 20}), 0.3, strict=False).count() == 21


def test_folds_are_disjoint_and_exhaustive(spark):
    df = labelled(spark, SIZES)
    runs = splits.stratified_runs(df, 5, 0.15, 42)
    folded = splits.stratified_kfold(df, 5, 42)
    assert rows(runs.select("id", "fold"), "id") == rows(folded.select("id", "fold"), "id")
    roles = splits.fold_roles(runs, 5)
    n = sum(SIZES.values())
    for run in range(1, 6):
        part = roles.filter(F.col("run") == run).collect()
        assert len(part) == n and len({r["id"] for r in part}) == n
        assert all((r["role"] == "test") == (r["fold"] == run) for r in part)
        rest = [r for r in part if r["role"] != "test"]
        # The closed form gives what a split of the other folds' rows gives.
        split = splits.stratified_split(folded.filter(F.col("fold") != run), 0.15, 42, names=("train", "val"))
        assert sorted((r["id"], r["role"]) for r in rest) == rows(split.select("id", "role"), "id")
        assert sum(r["role"] == "val" for r in rest) == math.ceil(0.15 * len(rest))
    tested = [r["id"] for r in roles.filter("role = 'test'").collect()]
    assert sorted(tested) == list(range(n))
    sizes = splits.split_sizes(roles, ["run"]).collect()
    assert all(r["n_train"] + r["n_val"] + r["n_test"] == n for r in sizes)


def test_guard_names_the_small_classes(spark):
    df = labelled(spark, {"a": 3, "b": 9}, "t").unionByName(labelled(spark, {"a": 9}, "u"))
    splits.require_min_class_count(df, 5)
    with pytest.raises(ValueError, match=r"t/a.*3"):
        splits.require_min_class_count(df, 5, group=["topic"])


def test_experiments(spark):
    df = labelled(spark, {"a": 2}, "x y").unionByName(labelled(spark, {"a": 3}, "z"))
    both = splits.expand_experiments(df)
    got = Counter(r["experiment_name"] for r in both.collect())
    assert got == {"ul_all_topics": 5, "ul_x_y": 2, "ul_z": 3}
    only = splits.expand_experiments(df, pooled=False, topics=["z"])
    assert Counter(r["experiment_name"] for r in only.collect()) == {"ul_z": 3}
    with pytest.raises(ValueError):
        splits.expand_experiments(df, pooled=False, per_topic=False)


def test_large_class_rank_shuffles_rows_once(spark):
    """The row side of the offset join reuses the ranking's partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = splits.stratified_kfold(labelled(spark, SIZES), 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    window = plan.index("Window [row_number()")
    above = plan[:window]
    # Between the last join and the ranking window there is no further exchange.
    assert "Exchange" not in above[above.rindex("SortMergeJoin"):window].split("\n", 1)[1]
