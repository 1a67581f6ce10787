"""Substring dedup on sentences: runs of consecutive sentences that were seen before are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.llm.common import text_key
from threadlab.session import materialise

RUN = 2
MIN_WORDS = 10
ALONE = 20  # words of a sentence that counts without a neighbour
# A sentence with its closing marks and the white space after it; the pieces make up the text.
PIECE = r"[^.!?\n]+[.!?\n]*[ \t\r\n]*|[.!?\n]+[ \t\r\n]*"
BLANK = r"[ \t\r\n]+"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def _spans(run: int, min_words: int, alone: int) -> Column:
    """Structs (start, size, span): the shortest long enough run from each sentence on and up to each
    sentence, and sentences long enough alone; a text with fewer than ``run`` sentences is one run.

    Long enough is ``run`` sentences and ``min_words`` words. Every sentence of a longer run lies in
    one of these that is inside the run, so what repeats in any length is found.
    """
    count, most = F.size("sentences"), max(run, min_words + 1)  # only a first sentence may have no word

    def long_enough(a: Column) -> Column:
        return (a["n"] >= run) & (a["words"] >= min_words)

    def grown(part: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
        return F.aggregate(
            part, begin, lambda a, w: F.when(long_enough(a), a).otherwise(
                F.struct((a["n"] + 1).alias("n"), (a["words"] + w).alias("words"))
            ), lambda a: F.when(long_enough(a), a["n"]),
        )

    def at_once(i: Column) -> Column:
        """Whether the first ``run`` sentences from ``i`` are long enough."""
        total = F.get("n_words", i)
        for k in range(1, run):
            total = total + F.get("n_words", i + k)
        return F.coalesce(total >= min_words, F.lit(False))

    def span(start: Column, size: Column) -> Column:
        return F.when(size > 0, F.struct(
            start.cast("int").alias("start"), size.cast("int").alias("size"),
            F.array_join(F.slice("sentences", start + 1, size), "\n").alias("span"),
        ))

    def forward(i: Column) -> Column:
        size = F.when(at_once(i), F.lit(run)).otherwise(grown(F.slice("n_words", i + 1, most)))
        return F.transform(F.array(size), lambda n: span(i, n))[0]

    def backward(i: Column) -> Column:
        low = F.greatest(i + 1 - most, F.lit(0))
        size = F.when(~at_once(i + 1 - run), grown(F.reverse(F.slice("n_words", low + 1, i + 1 - low))))
        return F.transform(F.array(size), lambda n: span(i + 1 - n, n))[0]

    def single(i: Column) -> Column:
        return F.when(F.get("n_words", i) >= alone, span(i, F.lit(1)))

    starts = F.sequence(F.lit(0), count - 1)
    each = F.flatten(F.transform(starts, lambda i: F.array(forward(i), backward(i), single(i))))
    whole = F.aggregate("n_words", F.lit(0), lambda a, w: a + w)
    short = F.when(whole >= min_words, F.array(span(F.lit(0), count)))
    made = F.when(count >= run, each).when(count > 0, short)
    return F.filter(made, lambda s: s.isNotNull())


def repeated_sentences(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, min_words: int = MIN_WORDS,
    alone: int = ALONE,
) -> DataFrame:
    """Rows (doc_id, text_key, covered): sentence numbers covered by a run that starts earlier, in a
    document with a smaller id or further up in the same one.

    A run has at least ``run`` sentences and ``min_words`` words, or is a sentence of ``alone`` words;
    shorter ones ("So it is. Yes.") recur by chance and do not count.
    Null ids come last; null and empty texts have no sentence. Repeated rows count once.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id",
        text_key("text").alias("text_key"),
        F.transform(pieces(F.col("text")), lambda p: F.trim(p, F.lit(" \t\r\n"))).alias("sentences"),
    )
    # Words are counted by the blanks between them: sentences hold no outer white space.
    counted = rows.withColumn(
        "n_words", F.transform("sentences", lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, BLANK))))
    )
    spans = counted.select("doc_id", "text_key", F.explode(_spans(run, min_words, alone)).alias("s")).select(
        F.xxhash64("s.span").alias("h1"),
        F.hash("s.span").alias("h2"),
        "doc_id",
        "text_key",
        F.col("s.start").alias("start"),
        F.col("s.size").alias("size"),
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "start")
    seen = materialise(
        spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last").drop("last"),
        "repeated-spans",
    )
    later = spans.join(seen, ["h1", "h2"]).where(place != F.col("first"))
    numbers = F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)))
    return later.groupBy("doc_id", "text_key").agg(F.array_distinct(numbers).alias("__covered"))


def drop_repeated(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the covered sentences; adds ``n_sentences`` and
    ``n_removed``. Rows are never dropped; a text that is all repeated becomes empty, null stays."""
    covered = repeated_sentences(docs, run=run, min_words=min_words).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__covered"
    )
    keyed = docs.withColumn("__text_key", text_key("text"))
    same = keyed.doc_id.eqNullSafe(covered["__id"]) & (keyed["__text_key"] == covered["__key"])
    joined = keyed.join(covered, same, "left").drop("__id", "__key", "__text_key")
    split = joined.withColumn("__pieces", pieces(F.col("text")))
    kept = F.array_join(
        F.filter("__pieces", lambda p, i: ~F.array_contains(F.coalesce("__covered", F.array().cast("array<int>")), i)), ""
    )
    return (
        split.withColumn("n_sentences", F.size("__pieces").cast("long"))
        .withColumn(
            "n_removed",
            F.coalesce(F.size(F.filter("__covered", lambda i: i < F.size("__pieces"))), F.lit(0)).cast("long"),
        )
        .withColumn("text", F.when(F.col("__covered").isNull(), F.col("text")).otherwise(kept))
        .drop("__covered", "__pieces")
    )
