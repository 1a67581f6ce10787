"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

All stages but the last return the columns they got, whatever their names: operators see the id and the
text only. A null text is a document without words: no stage but the last looks into it, and it ends as
one end token. Null ids are ids of their own, after all others. Repeated rows of an id and text share every
decision; near-duplicates keeps one of them. Of ties the smallest id stays. Texts are read whole,
however long. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlab.llm import decontamination, line_templates, ordinal, packing, simhash
from threadlab.llm.common import read
from threadlab.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _held(docs: DataFrame) -> DataFrame:
    """Id and text, and the whole row out of reach of the names that operators add."""
    return docs.select("doc_id", "text", F.struct("*").alias("__document"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is high enough. Texts without a word stay."""
    model = ordinal.train(docs, read(spark, sf_dir, "labels"))
    return ordinal.rate(_held(docs), model).where("kept").select("__document.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; ``n_chars`` follows the text. Every document stays."""
    cleaned = line_templates.drop_recurring(_held(docs))
    whole = F.col("__document").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("__document.n_chars"))
        whole = whole.withField("n_chars", length)
    return cleaned.select(whole.alias("__document")).select("__document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours."""
    return simhash.keep_one(_held(docs)).select("__document.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(_held(docs), read(spark, sf_dir, "benchmark")).select("__document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# The first stage learns its weights, which SQL cannot express; the tests rebuild the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
