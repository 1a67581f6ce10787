"""Deterministic stratified folds and splits.

Rows are ordered inside their class by md5(seed:id), an order any engine can reproduce.  A window
over the few classes would put each class in one task; instead the class is cut into buckets by the
first hex digits of the md5, rows are ranked inside their bucket, and the bucket's offset in the
class is added from prefix sums over bucket counts.  md5 spreads ids evenly, so buckets (and
tasks) stay level even if one class holds most rows.  The offset join uses the partitioning of the
ranking window, so rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlab.functions.text import safe_name

# 16**4 = 65,536 buckets per class: a class of 10**12 rows has about 1.5e7 rows per bucket, and
# the prefix sum of one class never covers more than 65,536 rows.
BUCKET_DIGITS = 4

POOLED = "ul_all_topics"


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def class_counts(df: DataFrame, label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))


def unstratifiable_classes(
    df: DataFrame, n_splits: int, label: str = "label", group: Sequence[str] = ()
) -> DataFrame:
    """Classes with fewer rows than folds."""
    return class_counts(df, label, group).filter(F.col("n") < n_splits)


def require_min_class_count(
    df: DataFrame, n_splits: int, label: str = "label", group: Sequence[str] = ()
) -> None:
    """Raise, naming every class too small for ``n_splits`` folds.  The driver sees class rows only."""
    bad = unstratifiable_classes(df, n_splits, label, group).orderBy(*group, label).collect()
    if bad:
        listed = {"/".join(str(v) for v in r[:-1]): r["n"] for r in bad}
        raise ValueError(f"classes with fewer than {n_splits} rows: {listed}")


def expand_experiments(
    df: DataFrame,
    topic: str = "topic",
    pooled: bool = True,
    per_topic: bool = True,
    topics: Sequence[str] | None = None,
) -> DataFrame:
    """Each row once per experiment it belongs to: the pooled one and its topic's, in one pass."""
    if not pooled and not per_topic:
        raise ValueError("choose pooled, per_topic or both")
    own = F.concat(F.lit("ul_"), safe_name(topic))
    if topics is not None:
        own = F.when(F.col(topic).isin(list(topics)), own)
    names = ([F.lit(POOLED)] if pooled else []) + ([own] if per_topic else [])
    return df.withColumn("experiment_name", F.explode(F.array_compact(F.array(*names))))


def _ranked(
    df: DataFrame,
    label: str,
    id_col: str,
    seed: int,
    group: Sequence[str],
    plan_classes: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``df`` with ``_rank`` (0-based in its class) and what ``plan_classes`` adds per class.

    ``plan_classes`` gets one row per class: ``(_group..., _label, _class_n)``.
    """
    groups = [f"_g{i}" for i in range(len(group))] or ["_g0"]
    group_values = [F.col(g) for g in group] or [F.lit(0)]
    keyed = df.withColumns(dict(zip(groups, group_values))).withColumns(
        {"_label": F.col(label), "_key": order_key(id_col, seed)}
    )
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    bucket = [*groups, "_label", "_bucket"]

    buckets = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*groups, "_label").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    classes = plan_classes(buckets.groupBy(*groups, "_label").agg(F.sum("_n").alias("_class_n")))
    offsets = offsets.join(classes, [*groups, "_label"]).drop("_n")

    inside = W.partitionBy(*bucket).orderBy("_key", id_col)
    ranked = keyed.withColumn("_in_bucket", F.row_number().over(inside) - 1)
    return ranked.join(offsets, bucket).withColumn("_rank", F.col("_before") + F.col("_in_bucket"))


def _groups_of(classes: DataFrame) -> list[str]:
    return [c for c in classes.columns if c.startswith("_g")]


def stratified_kfold(
    df: DataFrame,
    n_splits: int = 5,
    seed: int = 42,
    label: str = "label",
    id_col: str = "id",
    group: Sequence[str] = (),
) -> DataFrame:
    """Add ``fold`` (1..n_splits): rows in class order are dealt to the folds in turn.

    Fold sizes differ by at most one row, per class and overall.
    """

    def plan(classes: DataFrame) -> DataFrame:
        earlier = (
            W.partitionBy(*_groups_of(classes)).orderBy("_label").rowsBetween(W.unboundedPreceding, -1)
        )
        return classes.withColumn("_offset", F.coalesce(F.sum("_class_n").over(earlier), F.lit(0)))

    ranked = _ranked(df, label, id_col, seed, group, plan)
    fold = F.pmod(F.col("_offset") + F.col("_rank"), F.lit(n_splits)).cast("int") + 1
    return ranked.select(*df.columns, fold.alias("fold"))


def _quota(
    classes: DataFrame, n: str, test_size: float, out: str, group: Sequence[str], strict: bool
) -> DataFrame:
    """Per class, how many of its ``n`` rows stay on the train side (largest remainder, ties by label)."""
    total, k, n_test = F.col("_total"), F.col("_classes"), F.col("_n_test")
    whole = W.partitionBy(*group)
    wide = "decimal(18,0)"
    sized = classes.withColumns(
        {"_total": F.sum(n).over(whole), "_classes": F.count_if(F.col(n) > 0).over(whole)}
    ).withColumn("_n_test", F.ceil(F.lit(test_size) * F.col("_total")).cast("bigint"))
    if strict:
        problem = (
            F.when(F.min(n).over(whole) < 2, F.lit("a class has fewer than 2 rows"))
            .when(n_test < k, F.lit("test side has fewer rows than classes"))
            .when(total - n_test < k, F.lit("train side has fewer rows than classes"))
        )
        sized = sized.withColumn("_problem", problem).withColumn(
            "_n_test",
            F.when(F.col("_problem").isNotNull(), F.raise_error(F.col("_problem")).cast("bigint")).otherwise(n_test),
        )
    # Products of two row counts need more than 64 bits.
    product = F.col(n).cast(wide) * (total - n_test).cast(wide)
    shared = sized.withColumn("_product", product).withColumns(
        {
            "_floor": F.floor(F.try_divide(F.col("_product"), total.cast(wide))).cast("bigint"),
            "_rest": F.col("_product") % total.cast(wide),
        }
    )
    left = total - n_test - F.sum("_floor").over(whole)
    place = F.row_number().over(whole.orderBy(F.desc("_rest"), "_label"))
    return (
        shared.withColumns({"_left": left, "_place": place})
        .withColumn(out, F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0))
        .select(*classes.columns, out)
    )


def stratified_split(
    df: DataFrame,
    test_size: float = 0.15,
    seed: int = 42,
    label: str = "label",
    id_col: str = "id",
    group: Sequence[str] = (),
    names: tuple[str, str] = ("train", "test"),
    strict: bool = True,
) -> DataFrame:
    """Add ``role``: ceil(test_size * n) rows per group go to the second name, spread by class.

    ``strict`` raises for a class of one row, or for a side with fewer rows than classes.
    """

    def plan(classes: DataFrame) -> DataFrame:
        return _quota(classes, "_class_n", test_size, "_train", _groups_of(classes), strict)

    ranked = _ranked(df, label, id_col, seed, group, plan)
    role = F.when(F.col("_rank") < F.col("_train"), names[0]).otherwise(names[1])
    return ranked.select(*df.columns, role.alias("role"))


def train_val_test_split(
    df: DataFrame,
    holdout: float = 0.3,
    test_share: float = 0.5,
    seed: int = 42,
    label: str = "label",
    id_col: str = "id",
    group: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Add ``role`` train/val/test: a hold-out split, then a split of the held-out rows.

    Both stages order rows alike, so the second stage needs only class counts, not a second
    ranking of the rows.
    """

    def plan(classes: DataFrame) -> DataFrame:
        groups = _groups_of(classes)
        first = _quota(classes, "_class_n", holdout, "_train", groups, strict)
        rest = first.withColumn("_rest_n", F.col("_class_n") - F.col("_train"))
        return _quota(rest, "_rest_n", test_share, "_val", groups, strict)

    ranked = _ranked(df, label, id_col, seed, group, plan)
    rank = F.col("_rank")
    role = (
        F.when(rank < F.col("_train"), "train")
        .when(rank < F.col("_train") + F.col("_val"), "val")
        .otherwise("test")
    )
    return ranked.select(*df.columns, role.alias("role"))


def _dealt(start: Column, end: Column, fold: Column, n_splits: int) -> Column:
    """How many of the class-order positions in [start, end) were dealt to ``fold``."""

    def below(position: Column) -> Column:
        return F.floor((position - fold) / F.lit(n_splits))

    return below(end) - below(start)


def stratified_runs(
    df: DataFrame,
    n_splits: int = 5,
    val_size: float = 0.15,
    seed: int = 42,
    label: str = "label",
    id_col: str = "id",
    group: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Add ``fold`` and ``val_runs``: the runs whose training side lends this row to validation.

    In run r fold r is the test side and ``stratified_split`` of the other rows gives train and
    validation.  Rows are dealt to folds in turn, so a row's rank among the rows outside fold r
    follows from its class rank by arithmetic: one ranking of the rows serves every run.
    """
    runs = F.sequence(F.lit(1), F.lit(n_splits))

    def plan(classes: DataFrame) -> DataFrame:
        groups = _groups_of(classes)
        earlier = W.partitionBy(*groups).orderBy("_label").rowsBetween(W.unboundedPreceding, -1)
        placed = classes.withColumn("_offset", F.coalesce(F.sum("_class_n").over(earlier), F.lit(0)))
        per_run = placed.withColumn("_run", F.explode(runs)).withColumn(
            "_rest_n",
            F.col("_class_n")
            - _dealt(F.col("_offset"), F.col("_offset") + F.col("_class_n"), F.col("_run"), n_splits),
        )
        quotas = _quota(per_run, "_rest_n", val_size, "_train", [*groups, "_run"], strict)
        by_run = F.array_sort(F.collect_list(F.struct("_run", "_train")))
        return quotas.groupBy(*groups, "_label", "_class_n", "_offset").agg(by_run.alias("_quotas"))

    ranked = _ranked(df, label, id_col, seed, group, plan)
    offset, position = F.col("_offset"), F.col("_offset") + F.col("_rank")
    fold = F.pmod(position, F.lit(n_splits)).cast("int") + 1

    def lends(run: Column) -> Column:
        rank = F.col("_rank") - _dealt(offset, position, run, n_splits)
        return (run != fold) & (rank >= F.element_at("_quotas", run)["_train"])

    return ranked.select(*df.columns, fold.alias("fold"), F.filter(runs, lends).alias("val_runs"))


def fold_roles(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Rows of ``stratified_runs`` once per run, with ``run`` and ``role`` train, val or test."""
    run = F.col("run")
    role = (
        F.when(F.col("fold") == run, "test")
        .when(F.array_contains("val_runs", run), "val")
        .otherwise("train")
    )
    runs = F.explode(F.sequence(F.lit(1), F.lit(n_splits)))
    return df.withColumn("run", runs).withColumn("role", role)


def split_sizes(roles: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(group..., n_train, n_val, n_test)``."""
    return roles.groupBy(*group).agg(
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "val", "test")]
    )
