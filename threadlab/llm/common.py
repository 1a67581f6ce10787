"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\v\f\r"  # the characters \x20 and \x09-\x0D


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when the body is a lambda over elements."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def text_key(text: str) -> Column:
    """With doc_id it names a row by its content, so repeated rows share one decision."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
