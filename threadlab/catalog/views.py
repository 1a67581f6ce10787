"""Discussion-shaped views that Spark derives from the given tables, row for row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlab.functions.registry import COARSE_LABELS, LABEL_MAP
from threadlab.operators.labels import map_labels

# The lexicon the registered zero-shot query scores with.
TERMS = {
    COARSE_LABELS[0]: ("trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic",
                       "loser", "stupid", "disgusting"),
    COARSE_LABELS[1]: ("thaner", "oninth", "atthen", "ndthble"),
}
PRIORS = {COARSE_LABELS[2]: 0.5}
# One term per fine label and topic of the registered per-topic query; the last label
# wins where no term occurs.
FINE_TOPICS = {"en": "environment", "de": "health", "fr": "immigration", "es": "environment"}
FINE_TERMS = {
    "en": ("the", "and", "that", "her", "ing", "not"),
    "de": ("der", "und", "die", "ein", "ich", "nicht"),
    "fr": ("les", "que", "est", "dans", "une", "pas"),
    "es": ("los", "que", "del", "una", "con", "por"),
}
THREADS = 50


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _epoch(ts: str) -> Column:
    """Whole epoch seconds of a zone-less timestamp, whatever the session zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", origin, F.col(ts).cast("timestamp_ntz"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", _k())


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the comments of 50 threads; every parent is an earlier comment of the thread.

    A thread holds one row in fifty at any scale, so large inputs have large threads.
    """
    thread, n = F.col("event_id") % THREADS, F.expr(f"event_id div {THREADS}")
    parent = F.expr(f"(n * k) div 100 * {THREADS} + event_id % {THREADS}")
    return (
        events(spark, sf)
        .withColumn("n", n)
        .select(
            F.concat(F.lit("p"), thread).alias("post_id"),
            F.concat(F.lit("c"), "event_id").alias("id"),
            F.when(F.col("event_type") != "error", F.concat(F.lit("u"), "user_id")).alias("author"),
            F.concat_ws(" ", "event_type", "props").alias("body"),
            F.floor("value").cast("bigint").alias("score"),
            F.when((F.col("n") == 0) | (F.col("k") < 10), F.concat(F.lit("t3_p"), thread))
            .otherwise(F.concat(F.lit("t1_c"), parent))
            .alias("parent_fullname"),
            _epoch("ts").cast("double").alias("created_epoch"),
            F.col("n").alias("seq"),
        )
    )


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """One post per thread of ``comments``; odd ones carry old statistics."""
    number = F.substring("post_id", 2, 10).cast("int")
    old = F.when(number % 2 == 1, F.lit(1).cast("bigint"))
    return (
        comments(spark, sf)
        .groupBy("post_id")
        .agg(
            F.max("score").alias("score"),
            F.count(F.lit(1)).alias("num_comments"),
            F.min("author").alias("author"),
            F.min("created_epoch").alias("created_epoch"),
        )
        .withColumns(
            {
                "subreddit": F.concat(F.lit("s"), number % 7),
                "title": F.concat(F.lit("thread "), "post_id"),
                "url": F.concat(F.lit("https://example.org/"), "post_id"),
                "nodes": old,
                "edges": old,
                "time": F.lit(0.5),
            }
        )
    )


def done(spark: SparkSession, sf: str) -> DataFrame:
    """Threads taken as processed before: those whose first comment was a view or a purchase."""
    first = (F.col("seq") == 0) & F.col("body").rlike("^(view|purchase) ")
    return comments(spark, sf).filter(first).select("post_id")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    label = (
        F.when(F.col("toxic") == 1, "belief").when(F.col("quality") == 0, "fact-check").otherwise("other")
    )
    return (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("comment"),
            F.col("lang").alias("topic"),
            label.alias("label"),
        )
    )


def gold_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """``gold`` with the faults real annotation tables have, dealt out by id."""
    kind, nbsp = F.col("id") % 10, "\u00a0"
    comment = (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, "[Removed]")
        .when(kind == 2, "[deleted]")
        .when(kind == 3, "two words")
        .when(kind == 6, F.replace("comment", F.lit(" "), F.lit(nbsp)))
        .otherwise(F.col("comment"))
    )
    label = (
        F.when(kind == 4, " Fact_Check ")
        .when(kind == 5, "fact check")
        .when(kind == 7, F.lit(None).cast("string"))
        .otherwise(F.col("label"))
    )
    return gold(spark, sf).select(
        "id",
        comment.alias("comment"),
        F.when(kind == 4, " EN\t").otherwise(F.col("topic")).alias("topic"),
        label.alias("label"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as labelled predictions; the label map leaves ``political`` as it is."""
    raw = F.create_map(
        *[
            F.lit(x)
            for x in (
                "click", "spreads misinformation", "view", "photoshop", "purchase", "meta",
                "signup", "political", "error", "off-topic",
            )
        ]
    )
    rows = events(spark, sf).select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("topic"),
        F.when(F.col("k") < 30, "belief").when(F.col("k") < 60, "fact-check").otherwise("other").alias("gold"),
        raw[F.col("event_type")].alias("pred_raw"),
        F.col("value").alias("max_logit"),
        (F.col("event_id") % 5 + 1).cast("int").alias("fold"),
        F.concat(F.lit("m"), F.col("event_id") % 2).alias("model_key"),
    )
    return map_labels(rows, LABEL_MAP, "pred_raw", "pred")


def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Three scores per event with many ties, in long form."""
    names = F.array(*[F.lit(c) for c in ("belief", "fact-check", "other")])
    return (
        events(spark, sf)
        .select(F.col("event_id").alias("id"), F.posexplode(names).alias("pos", "label"))
        .withColumn("score", (F.col("id") * (F.col("pos") + 3) * 7919) % 10 / F.lit(10.0))
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of ten epochs."""
    return events(spark, sf).select(
        F.expr("event_id div 10").alias("run"),
        (F.col("event_id") % 10 + 1).cast("int").alias("epoch"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("loss"),
        (F.floor(F.col("value") / 5.0) / 100.0).alias("eval_metric"),
    )
