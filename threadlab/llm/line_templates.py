"""Line dedup by a log-template tree of fixed depth.

A line goes to the leaf named by its token count and its leading tokens, tokens with a digit being
variable. Inside a leaf a token is constant where enough documents have it at that position, and a
field otherwise; a line with its fields masked is a template of it. Enough is a number of documents,
whatever the size of the leaf: every level of ``LEVELS`` gives a line one template with tokens with a
digit as they are and one with all of them masked. So the template of n documents shows at the last
level below n, where rarer values of its fields are masked. Lines are dropped if one of their
templates recurs across documents. Near copies of one document share nearly all their lines, which
would go from all of them: of documents that would lose most of their text, the first one of each
family keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.llm.common import text_key, words
from threadlab.session import materialise

DEPTH = 3
MIN_DOCS = 5
LEVELS = [4**k for k in range(14)]  # times min_docs: documents that make a token constant
SIMILARITY = 0.6  # of a line's tokens that must be constant; fields with a digit do not count
CONSTANTS = 2  # tokens that must be constant, in a line that has as many
MOST = 0.5  # of the characters of a document's lines: more than this makes it one of a family
FIELD = "<*>"


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def leaf(line: Column, depth: int = DEPTH) -> Column:
    """Hex digest of the token count and the leading tokens."""
    def named(tokens: Column) -> Column:
        lead = F.transform(F.slice(tokens, 1, depth), _masked)
        return F.md5(F.concat(F.size(tokens).cast("string"), F.lit(" "), F.array_join(lead, " ")))

    return F.transform(F.array(words(line)), named)[0]


def _lines(text: Column) -> Column:
    """Distinct lines with a word."""
    return F.array_distinct(
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    )


def candidates(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines of leaves that enough documents reach: (doc_id, text_key, once, size, leaf, name, line),
    ``name`` being a digest of the line and ``size`` the characters of all lines of the document.

    ``once`` is true in one row of each distinct text: copies of a document count once.
    """
    parsed = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        text_key("text").alias("text_key"),
        F.transform(_lines(F.col("text")), lambda s: F.struct(leaf(s, depth).alias("leaf"), s.alias("line"))).alias("l"),
    )
    # Written once: the readers below, and the filter Spark puts before an explode, would parse again.
    each = materialise(parsed, "document-lines")
    copied = materialise(
        each.where(F.size("l") > 0).groupBy("text_key").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        .where("n > 1").drop("n"),
        "copied-texts",
    )
    counted = each.join(copied, "text_key", "left").withColumn("once", F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    leaves = materialise(
        counted.where("once").select(F.explode("l.leaf").alias("leaf"))
        .groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"),
        "leaves",
    )
    # Below the explode: above it the lines of a document would be added up for each of them.
    size = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    sized = counted.withColumn("size", size)
    lines = sized.select("doc_id", "text_key", "once", "size", F.explode("l").alias("x")).select(
        "doc_id", "text_key", "once", "size", "x.leaf", F.md5("x.line").alias("name"), "x.line"
    )
    return materialise(lines.join(leaves, "leaf"), "candidate-lines")


def _forms(tokens: Column, min_docs: int) -> Column:
    """Digests of the templates of a line, one for each level and way to mask.

    ``tokens`` are structs (i, token, support, digit) in the order of the line.
    """
    def form(level: Column, mask: Column) -> Column:
        def constant(x: Column) -> Column:
            return F.coalesce(x["support"] >= level, F.lit(False)) & ~(mask & x["digit"])

        constants = F.size(F.filter(tokens, constant))
        told = F.size(F.filter(tokens, lambda x: constant(x) | ~x["digit"]))
        enough = (constants >= F.least(F.lit(CONSTANTS), F.size(tokens))) & (constants >= SIMILARITY * told)
        masked = F.transform(tokens, lambda x: F.when(constant(x), x["token"]).otherwise(F.lit(FIELD)))
        return F.when(enough, F.md5(F.array_join(masked, " ")))

    top = F.array_max(F.transform(tokens, lambda x: x["support"]))
    levels = F.filter(F.array(*[F.lit(min_docs * k).cast("long") for k in LEVELS]), lambda t: t <= top)
    ways = F.array(F.lit(False), F.lit(True))
    return F.array_distinct(F.flatten(F.transform(
        levels, lambda t: F.filter(F.transform(ways, lambda m: form(t, m)), lambda x: x.isNotNull())
    )))


def templates(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Templates of the candidate lines: (name, template), digests; a distinct line has one or more."""
    distinct = materialise(
        lines.groupBy("leaf", "name").agg(F.any_value("line").alias("line"), F.count_if("once").alias("n")),
        "distinct-lines",
    )
    tokens = distinct.select("leaf", "name", "n", F.posexplode(words(F.col("line"))).alias("i", "token"))
    support = materialise(
        tokens.groupBy("leaf", "i", "token").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs),
        "token-support",
    )
    placed = F.struct("i", "token", "support", F.col("token").rlike("[0-9]").alias("digit"))
    whole = tokens.join(support, ["leaf", "i", "token"], "left").groupBy("name").agg(
        F.sort_array(F.collect_list(placed)).alias("tokens")
    )
    return whole.select("name", F.explode(_forms(F.col("tokens"), min_docs)).alias("template"))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, most: float = MOST) -> DataFrame:
    """(doc_id, text_key, dropped): digests of the lines of a document with a recurring template.

    A template recurs if at least ``min_docs`` distinct texts have it, however many copies there
    are of each: copies neither make a template nor protect one. The first document of a family of
    near copies (``whole_families``) is left out.
    """
    lines = candidates(docs, depth, min_docs)
    found = materialise(templates(lines, min_docs), "templates")
    common = (
        lines.where("once").select("name", "text_key").join(found, "name").select("template", "text_key").distinct()
        .groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    )
    names = found.join(materialise(common, "recurring-templates"), "template").select("name").distinct()
    dropped = materialise(
        lines.join(materialise(names, "recurring-lines"), "name").groupBy("doc_id", "text_key").agg(
            F.collect_set("name").alias("__dropped"), F.sum(F.length("line")).alias("lost"), F.max("size").alias("size")
        ),
        "dropped-lines",
    )
    first = whole_families(dropped, most).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = dropped.doc_id.eqNullSafe(first["__id"]) & (dropped.text_key == first["__key"])
    return dropped.join(first, same, "left_anti").select("doc_id", "text_key", "__dropped")


def whole_families(dropped: DataFrame, most: float = MOST) -> DataFrame:
    """(doc_id, text_key) of the documents that keep their lines: the first of each family.

    A family are different texts that would lose more than ``most`` of the characters of their lines
    and share the lowest digest, or the lowest one read backwards, of the lines they would lose. So
    documents of which most is the same are found, however many there are, while pages made of
    templates with different fields are no family.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    lowest = F.array(
        F.array_min("__dropped"), F.array_min(F.transform("__dropped", lambda x: F.concat(F.lit("r"), F.reverse(x))))
    )
    return (
        dropped.where(F.col("lost") > most * F.col("size"))
        .select(F.explode(lowest).alias("mark"), "text_key", place.alias("place"))
        .groupBy("mark")
        .agg(F.min("place").alias("first"), F.min("text_key").alias("a"), F.max("text_key").alias("b"))
        .where("a <> b").select("first.doc_id", "first.text_key").distinct()
    )


def drop_recurring(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (doc_id, text, ...) without recurring lines; adds ``n_lines`` and ``n_dropped``, which
    replace columns of those names.

    Of a family of near copies the first document stays whole. Every row stays; a text of recurring lines only becomes empty, a null text stays null. Lines
    without a word are kept. Repeated rows get the same result and count as one document; a null
    id is an id like any other.
    """
    dropped = recurring_lines(docs, depth, min_docs).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__dropped"
    )
    keyed = docs.withColumn("__text_key", text_key("text"))
    same = keyed.doc_id.eqNullSafe(dropped["__id"]) & (keyed["__text_key"] == dropped["__key"])
    # The same plan at every size: a broadcast that fits a small table would not fit a large one.
    joined = keyed.join(dropped.hint("merge"), same, "left").drop("__id", "__key", "__text_key")
    parts = F.split("text", "\n", -1)
    kept = F.filter(parts, lambda s: ~F.array_contains("__dropped", F.md5(s)))
    touched = F.col("__dropped").isNotNull()
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"))
        .withColumn("__kept", F.when(touched, kept))
        .withColumn("n_dropped", F.when(touched, F.col("n_lines") - F.size("__kept")).otherwise(F.lit(0)).cast("long"))
        .withColumn("text", F.when(touched, F.array_join("__kept", "\n")).otherwise(F.col("text")))
        .drop("__dropped", "__kept")
    )
