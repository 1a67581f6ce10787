"""Label maps and label ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlab.functions.text import normalize_label, normalize_topic
from threadlab.operators.skew import lookup_join


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Plan-time check that names what is missing and what there is."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")


def topic_filter(df: DataFrame, topic: str, column: str = "topic") -> DataFrame:
    """Exact match, so that the predicate reaches the scan."""
    return df.filter(F.col(column) == F.lit(topic))


def prepare_gold(
    df: DataFrame,
    text: str = "comment",
    topic: str = "topic",
    label: str = "label",
    topics: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with text, topic and label, the latter two in one spelling."""
    require_columns(df, [text, topic, label])
    ready = df.dropna(subset=[text, topic, label]).withColumns(
        {
            text: F.col(text).cast("string"),
            topic: normalize_topic(topic),
            label: normalize_label(label),
        }
    )
    return ready.filter(F.col(topic).isin(list(topics))) if topics is not None else ready


def missing_topics(df: DataFrame, topics: Sequence[str], topic: str = "topic") -> list[str]:
    """Topics of the list that have no row; one aggregate serves them all."""
    found = {r[0] for r in df.filter(F.col(topic).isin(list(topics))).select(topic).distinct().collect()}
    return [t for t in topics if t not in found]


def map_labels(
    df: DataFrame,
    mapping: Mapping[str, str] | DataFrame,
    column: str = "pred_label",
    out: str = "pred_label_mapped",
) -> DataFrame:
    """Replace labels found in ``mapping``; the others pass through unchanged.

    A dict becomes a literal map, so rows need no join.  A table (label, mapped) is broadcast only
    after a count shows it small.
    """
    if isinstance(mapping, DataFrame):
        table = mapping.select(F.col("label").alias(column), F.col("mapped").alias("_mapped"))
        joined = lookup_join(df, table, [column])
        return joined.withColumn(out, F.coalesce("_mapped", column)).select(
            *[c for c in df.columns if c != out], out
        )
    if not mapping:
        return df.withColumn(out, F.col(column))
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def class_index(
    df: DataFrame, label: str = "label", group: Sequence[str] = ()
) -> DataFrame:
    """``(group..., label, label_id)``: ids from 0 in label order, within each group.

    The window runs over distinct labels, a handful of rows.
    """
    keys = list(group)
    window = W.partitionBy(*(keys or [F.lit(0)])).orderBy(label)
    return (
        df.select(*keys, label)
        .filter(F.col(label).isNotNull())
        .distinct()
        .withColumn("label_id", F.row_number().over(window) - 1)
    )


def encode_labels(
    df: DataFrame,
    classes: DataFrame,
    label: str = "label",
    group: Sequence[str] = (),
) -> DataFrame:
    """Add ``label_id``; a label outside ``classes`` is an error, as it would be at training."""
    known = lookup_join(df, classes, [*group, label])
    problem = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))
    return known.withColumn(
        "label_id", F.when(F.col("label_id").isNull(), problem.cast("int")).otherwise(F.col("label_id"))
    ).select(*df.columns, "label_id")
