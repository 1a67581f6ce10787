"""Registered queries of the training-data operators: (spark, folder of the given tables) -> rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlab.llm import (
    bpe, chat, decontamination, language, line_templates, ordinal, packing, resampling, rules, sentence_spans, simhash,
    suffixes, whitening,
)
from threadlab.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hierarchical_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_templates.drop_recurring(read(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op3_decision_list(spark: SparkSession, sf: str) -> DataFrame:
    judged, _ = rules.judge(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "rule")


@query
def op4_language_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_ordinal_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = ordinal.train(docs, read(spark, sf, "labels"))
    return ordinal.rate(docs, model).select("doc_id", "expected_grade", "tail", "kept")


@query
def op6_string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark")).drop("text_key")


@query
def op7_suffix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.removal_digests(read(spark, sf, "documents"))


@query
def op8_snapshot_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return chat.render(read(spark, sf, "conversations"))


@query
def op9_simhash_balls(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op10_sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = sentence_spans.drop_repeated(read(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_sentences", "n_removed", "text")


@query
def op11_speculative_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(read(spark, sf, "documents").select("doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_exact_whitening(spark: SparkSession, sf: str) -> DataFrame:
    # The exact sum of squares outgrows a long on some 10^8 vectors; the operator's own column is wider.
    return whitening.whiten(read(spark, sf, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query
def op13_bit_sliced_resampling(spark: SparkSession, sf: str) -> DataFrame:
    scored = resampling.resample(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")
