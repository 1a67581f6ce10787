"""Comment trees, reply edges and reply networks, for all threads in one job.

A comment is keyed by (post_id, id): ids are only unique within their thread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.functions.text import bare_id, epoch_to_iso
from threadlab.operators.skew import HOT_ROWS, rank_in_groups
from threadlab.session import materialise

# Kind prefix of a parent that is a comment; text written for an unknown author.
COMMENT_PREFIX = "t1_"
UNKNOWN_AUTHOR = "None"

LINK_PATTERN = r"/r/([^/]+)/comments/([^/]+)/([^/]+)"

KEY = ["post_id", "id"]
# What the tree and the reply edges need of a comment besides its key.
NAMES = ["parent_fullname", "author"]

# Longest ancestor path a row carries before it is replaced by a rank.
MAX_PATH = 64


def resolve_links(posts: DataFrame, link: str = "link", pattern: str = LINK_PATTERN) -> DataFrame:
    """Add the three parts a post's link names (community, post id, title slug), null if absent."""

    def part(i: int) -> Column:
        found = F.regexp_extract(F.col(link), pattern, i)
        return F.when(found != "", found)

    return posts.withColumns(
        {"link_subreddit": part(1), "link_id": part(2), "link_title": part(3)}
    )


def fill_from_links(posts: DataFrame, pattern: str = LINK_PATTERN) -> DataFrame:
    """Fill missing post_id/subreddit/title from the link; ``link_ok`` is false where they disagree.

    Takes what ``readers.read_posts`` returns.
    """
    resolved = resolve_links(posts, pattern=pattern)
    parts = {"subreddit": "link_subreddit", "post_id": "link_id", "title": "link_title"}
    agrees = reduce(
        lambda a, b: a & b,
        [F.coalesce(F.col(c) == F.col(found), F.lit(True)) for c, found in parts.items()],
    )
    filled = {c: F.coalesce(c, found) for c, found in parts.items()}
    return (
        resolved.withColumn("link_ok", agrees)
        .withColumns(filled)
        .drop("link_subreddit", "link_id", "link_title")
    )


def pending_posts(posts: DataFrame, done: DataFrame) -> DataFrame:
    """Posts with no output yet, so that a re-run does only what is missing."""
    return posts.join(done.select("post_id").distinct(), "post_id", "left_anti")


def comments_of(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments of the listed posts; adaptive execution splits a post with very many comments."""
    return raw.join(posts.select("post_id").distinct(), "post_id", "left_semi").select(*raw.columns)


def _is_reply() -> Column:
    return F.col("parent_fullname").startswith(COMMENT_PREFIX)


def comment_rows(raw: DataFrame, *more: str) -> DataFrame:
    """Typed comment rows: bare parent id, top-level flag, ISO time, columns ``more``.  Author stays nullable."""
    return raw.select(
        *KEY,
        "author",
        "body",
        "score",
        bare_id("parent_fullname").alias("parent_id"),
        (~_is_reply()).alias("is_top_level"),
        epoch_to_iso("created_epoch").alias("created_utc"),
        "seq",
        *more,
    )


def flatten_threads(threads: DataFrame) -> DataFrame:
    """Thread records -> one row per comment, in record order."""
    return threads.select(
        F.col("submission.id").alias("post_id"), F.posexplode("comments").alias("pos", "c")
    ).select("post_id", "pos", "c.*")


def thread_edges(threads: DataFrame) -> DataFrame:
    """Thread records -> the reply edges stored in them."""
    return threads.select(
        F.col("submission.id").alias("post_id"), F.explode("reply_network").alias("e")
    ).select("post_id", "e.*")


def _unique(raw: DataFrame, **kept: list[str]) -> DataFrame:
    """One row per comment; for each name a struct of ``seq`` and the columns kept under it.

    Keys that are sorted begin with the id: sorts compare the leading bytes of the first column first,
    and few post ids are shared by all rows.
    """
    lowest = [F.min(F.struct("seq", *columns)).alias(name) for name, columns in kept.items()]
    return raw.groupBy("id", "post_id").agg(*lowest).select(*KEY, *kept)


def unique_comments(raw: DataFrame, columns: list[str]) -> DataFrame:
    """One row per comment: dumps are landed again, and a repeated id would multiply every join.

    Of the rows of one id the one with the lowest ``seq`` counts, then the lowest ``columns``.
    """
    return _unique(raw, row=columns).select(*KEY, "row.*")


def comment_links(raw: DataFrame) -> DataFrame:
    """``(post_id, id, num, seq, author, is_reply, up, up_author)`` for every comment, written.

    ``num`` is a number of the comment's own; ``up`` and ``up_author`` are of the comment it answers, null
    where that is not in the dump.  Later joins compare numbers in place of two names.
    """
    return _link(materialise(unique_comments(raw, NAMES).withColumn("num", F.monotonically_increasing_id()), "names"))


def _link(names: DataFrame) -> DataFrame:
    """The links of unique, numbered and written ``names``."""
    is_reply = F.coalesce(_is_reply(), F.lit(False))
    own = names.select(*KEY, "num", "seq", "author", is_reply.alias("is_reply"), bare_id("parent_fullname").alias("parent_id"))
    parents = names.select(
        F.col("id").alias("parent_id"), "post_id", F.col("num").alias("up"), F.col("author").alias("up_author")
    )
    # A parent with very many answers is split by adaptive execution.
    replies = own.filter("is_reply").join(parents, ["parent_id", "post_id"], "left").drop("parent_id")
    tops = own.filter("NOT is_reply").drop("parent_id")
    return materialise(replies.unionByName(tops, allowMissingColumns=True).select(
        *KEY, "num", "seq", "author", "is_reply", "up", "up_author"
    ), "links")


def thread_paths(
    raw: DataFrame,
    hot_rows: int = HOT_ROWS,
    max_path: int = MAX_PATH,
    with_path: bool = True,
    links: DataFrame | None = None,
) -> DataFrame:
    """``(post_id, id, num, depth, path, reachable)`` for every comment; ``path`` is empty unless wanted.

    ``path`` orders the comments of one depth of a thread: breadth-first order is the order of
    (depth, path, id).  It starts as the sibling order numbers from the top-level ancestor down.
    Computed by pointer doubling among the comments that have an answer: each round joins the
    unfinished ones to the ancestor they point at and doubles the distance, so a thread of depth d
    takes about log2(d) rounds.  Finished comments are not written again, but each round reads them as
    possible ancestors.  In the end every comment takes depth and path from the one it answers.  When
    paths reach ``max_path`` numbers, each is replaced by its rank in the thread, which keeps the order
    and bounds the row.  Comments whose chain of parents leaves the dump or loops are kept with
    ``reachable = false`` and null depth.  ``links`` may pass the result of ``comment_links``.
    """
    links = comment_links(raw) if links is None else links
    own = F.array("seq") if with_path else F.array().cast("array<bigint>")
    answered = links.filter("up IS NOT NULL").select(F.col("up").alias("num")).distinct()
    state = materialise(
        links.join(answered, "num", "left_semi").select(
            "num",
            F.col("up").alias("anc"),
            own.alias("path"),
            F.lit(1).cast("bigint").alias("levels"),
            (F.col("is_reply") & F.col("up").isNull()).alias("lost"),
        ),
        "paths",
    )
    finished, todo = [state.filter("anc IS NULL")], state.filter("anc IS NOT NULL")
    left, width = todo.count(), 1
    # After r rounds only chains of more than 2^r ancestors are unfinished; none is longer than the dump.
    rounds = left.bit_length() + 1
    while left:
        rounds -= 1
        known = reduce(DataFrame.unionByName, finished + [todo])
        if with_path and width >= max_path:
            named = known.join(links.select("num", *KEY), "num")
            ranked = rank_in_groups(named, ["post_id"], ["path", "id"], "rank", hot_rows)
            known = materialise(ranked.withColumn("path", F.array("rank")).drop("rank", *KEY), "paths")
            finished, todo, width = [known.filter("anc IS NULL")], known.filter("anc IS NOT NULL"), 1
        ancestor = known.select(
            F.col("num").alias("anc"),
            F.col("anc").alias("up_anc"),
            F.col("path").alias("up_path"),
            F.col("levels").alias("up_levels"),
            F.col("lost").alias("up_lost"),
        )
        # An ancestor with very many comments below it is split by adaptive execution.
        joined = todo.join(ancestor, "anc")
        lost = F.col("up_lost")
        state = materialise(
            joined.select(
                "num",
                F.when(~lost, F.col("up_anc")).alias("anc"),
                F.when(~lost, F.concat("up_path", "path")).otherwise(F.col("path")).alias("path"),
                F.when(~lost, F.col("up_levels") + F.col("levels")).otherwise(0).alias("levels"),
                lost.alias("lost"),
            ),
            "paths",
        )
        todo, width = state.filter("anc IS NOT NULL"), 2 * width
        still = todo.count()
        if still and (still == left or not rounds):
            # In a forest the number of unfinished comments falls every round, so all that remain
            # hang on a loop of parents.
            finished += [state.filter("anc IS NULL"), todo.withColumn("lost", F.lit(True))]
            break
        finished.append(state.filter("anc IS NULL"))
        left = still
    above = reduce(DataFrame.unionByName, finished).select(
        F.col("num").alias("up"), F.col("path").alias("up_path"), "levels", "lost"
    )
    placed = links.select(*KEY, "num", "seq", "is_reply", "up")
    replies = placed.filter("up IS NOT NULL").join(above, "up").select(
        *KEY,
        "num",
        F.when(~F.col("lost"), F.col("levels")).cast("int").alias("depth"),
        F.when(~F.col("lost"), F.concat("up_path", own)).alias("path"),
        (~F.col("lost")).alias("reachable"),
    )
    rest = placed.filter("up IS NULL").select(
        *KEY,
        "num",
        F.when(~F.col("is_reply"), 0).alias("depth"),
        F.when(~F.col("is_reply"), own).alias("path"),
        (~F.col("is_reply")).alias("reachable"),
    )
    return replies.unionByName(rest)


def comment_depth(raw: DataFrame) -> DataFrame:
    """Depth per comment, 0 at the top level; null where no top-level ancestor exists."""
    return thread_paths(raw, with_path=False).select(*KEY, "depth")


def bfs_order(raw: DataFrame, hot_rows: int = HOT_ROWS, max_path: int = MAX_PATH) -> DataFrame:
    """``(post_id, id, depth, bfs_pos)``: breadth-first position, 0-based, siblings by ``seq``."""
    return _ranked(comment_links(raw), hot_rows, max_path).select(*KEY, "depth", "bfs_pos")


def _ranked(links: DataFrame, hot_rows: int, max_path: int = MAX_PATH) -> DataFrame:
    """Reachable comments of ``links`` with their breadth-first position ``bfs_pos``.

    Their paths are written only if a thread may be too large for one window: ranking reads them again.
    """
    paths = thread_paths(links, hot_rows, max_path, links=links)
    placed = paths.filter("reachable").drop("reachable")
    largest = links.groupBy("post_id").count().agg(F.max("count")).first()[0] or 0
    if largest > hot_rows:
        placed = materialise(placed, "placed")
    return rank_in_groups(placed, ["post_id"], ["depth", "path", "id"], "bfs_pos", hot_rows, largest)


def orphan_comments(raw: DataFrame) -> DataFrame:
    """Comments that no top-level comment leads to; an intact dump has none."""
    return thread_paths(raw, with_path=False).filter("NOT reachable").select(*KEY)


def reply_edges(raw: DataFrame) -> DataFrame:
    """``(post_id, source, target, comment_id)``: who answered whom; self-replies are kept.

    A plain equi-join on the parent: filters run before it, the unique comments without their texts
    are written once for both sides, and a parent with very many answers is split by adaptive execution.
    """
    raw = materialise(unique_comments(raw, NAMES), "names")
    replies = raw.filter(_is_reply() & F.col("author").isNotNull()).select(
        "post_id",
        bare_id("parent_fullname").alias("parent_id"),
        F.col("author").alias("source"),
        F.col("id").alias("comment_id"),
    )
    parents = raw.filter(F.col("author").isNotNull() & (F.col("author") != "")).select(
        "post_id", F.col("id").alias("parent_id"), F.col("author").alias("target")
    )
    return replies.join(parents, ["parent_id", "post_id"]).select("post_id", "source", "target", "comment_id")


def _edges(links: DataFrame) -> DataFrame:
    """``(post_id, id, num, source, target)``: the reply edges by the rule of ``reply_edges``, from links."""
    # A comment that answers none in the dump has no ``up_author``.
    kept = links.filter(F.col("author").isNotNull() & F.col("up_author").isNotNull() & (F.col("up_author") != ""))
    return kept.select(*KEY, "num", F.col("author").alias("source"), F.col("up_author").alias("target"))


def distinct_edges(raw: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges with parallels collapsed; the comment last in breadth-first order names the edge.

    The last one is found by (depth, path) directly, so no position has to be numbered.
    """
    links = comment_links(raw)
    order = thread_paths(raw, hot_rows, links=links).filter("reachable").select(
        "num", F.struct("depth", "path", "id").alias("at")
    )
    return (
        _edges(links)
        .filter(F.col("id").isNotNull())
        .join(order, "num")
        .groupBy("post_id", "source", "target")
        .agg(F.max_by("id", "at").alias("comment_id"), F.count(F.lit(1)).alias("n_replies"))
    )


def reply_network_stats(edges: DataFrame) -> DataFrame:
    """``(post_id, nodes, edges)``: people with an edge, and distinct directed edges, per thread.

    Node and edge names share one de-duplicating shuffle, keyed finely enough that a large thread
    spreads over all tasks; only counts are shuffled by thread.
    """
    none = F.lit(None).cast("string")
    item = F.explode(
        F.array(
            F.struct(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(True).alias("e")),
            F.struct(F.col("source").alias("a"), none.alias("b"), F.lit(False).alias("e")),
            F.struct(F.col("target").alias("a"), none.alias("b"), F.lit(False).alias("e")),
        )
    )
    return (
        edges.select("post_id", item.alias("i"))
        .select("post_id", "i.*")
        .distinct()
        .groupBy("post_id")
        .agg(F.count_if(~F.col("e")).alias("nodes"), F.count_if("e").alias("edges"))
    )


def upsert_post_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """Post list with fresh node and edge counts; posts not in ``stats`` keep their old values."""
    fresh = stats.select(
        "post_id", F.col("nodes").alias("new_nodes"), F.col("edges").alias("new_edges")
    )
    return (
        posts.join(fresh, "post_id", "left")
        .withColumns(
            {"nodes": F.coalesce("new_nodes", "nodes"), "edges": F.coalesce("new_edges", "edges")}
        )
        .select(*posts.columns)
    )


def thread_documents(
    raw: DataFrame,
    submissions: DataFrame,
    max_comments: int = 10_000,
    hot_rows: int = HOT_ROWS,
    edges: DataFrame | None = None,
) -> DataFrame:
    """One nested record per thread: submission, comments and reply network in breadth-first order.

    A thread of more than ``max_comments`` comments continues in further records
    (``part`` = 0, 1, ... of ``n_parts``), so no record and no task holds an unbounded thread.
    ``dump_id`` is a digest of the comments and of ``max_comments``: records of one thread with
    different digests are of different dumps and must not be put together.  ``submissions`` has
    post_id, title, url, score, num_comments, author, created_epoch; ``edges`` may pass the
    result of ``reply_edges`` if it is at hand.
    """
    author = F.coalesce("author", F.lit(UNKNOWN_AUTHOR))
    # Comments are made unique once, for their texts and for the tree, and numbered for the joins.
    both = _unique(raw, row=[c for c in raw.columns if c not in {*KEY, "seq"}], names=NAMES)
    row = comment_rows(both.select(*KEY, "row.*", "names"), "names")
    digest = F.xxhash64(*[c for c in row.columns if c != "names"])
    written = materialise(
        row.withColumns({"digest": digest, "num": F.monotonically_increasing_id()}), "comments"
    )
    links = _link(written.select(*KEY, "num", "names.*"))
    order = materialise(
        _ranked(links, hot_rows).select("post_id", "num", "depth", "bfs_pos"), "order"
    )
    dumps = written.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("digest").alias("digest"))
    # A comment without an id has a place in the order, but none in the record.
    named = written.filter(F.col("id").isNotNull() & F.col("post_id").isNotNull())
    placed = named.select("id", "author", "body", "score", "parent_id", "created_utc", "num").join(order, "num")
    if edges is None:
        placed = placed.join(_edges(links).select("num", "source", "target"), "num", "left")
    else:
        given = edges.select("post_id", F.col("comment_id").alias("id"), "source", "target")
        placed = placed.join(given, ["id", "post_id"], "left")
    placed = placed.withColumn("part", F.floor(F.col("bfs_pos") / F.lit(max_comments)).cast("bigint"))
    comment = F.struct(
        "id", author.alias("author"), "body", "score", "parent_id", "depth", "created_utc"
    )
    edge = F.struct("source", "target", F.col("id").alias("comment_id"))
    item = F.struct("bfs_pos", comment.alias("c"), F.when(F.col("target").isNotNull(), edge).alias("e"))
    pieces = (
        placed.select("post_id", "part", item.alias("item")).repartition("post_id", "part")
        .groupBy("post_id", "part")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select(
            "post_id",
            "part",
            F.col("items.c").alias("comments"),
            F.filter(F.col("items.e"), lambda e: e.isNotNull()).alias("reply_network"),
        )
    )
    # Submissions meet the (post_id, part) pairs first: those rows are light, while the pieces of
    # one thread joined on post_id alone would all land in one task.
    heads = submissions.select(
        "post_id",
        F.struct(
            F.col("post_id").alias("id"),
            "title",
            "url",
            "score",
            "num_comments",
            author.alias("author"),
            epoch_to_iso("created_epoch").alias("created_utc"),
        ).alias("submission"),
    )
    last = order.groupBy("post_id").agg(F.max("bfs_pos").alias("last"))
    parts = F.sequence(
        F.lit(0).cast("bigint"),
        F.coalesce(F.floor(F.col("last") / F.lit(max_comments)), F.lit(0)).cast("bigint"),
    )
    dump_id = F.lower(F.hex(F.xxhash64(F.coalesce("n", F.lit(0)), F.coalesce("digest", F.lit(0)), F.lit(max_comments))))
    numbered = heads.join(last, "post_id", "left").join(dumps, "post_id", "left").select(
        "post_id", "submission", F.size(parts).cast("bigint").alias("n_parts"), dump_id.alias("dump_id"),
        F.explode(parts).alias("part"),
    )
    empty_comments = F.array().cast(pieces.schema["comments"].dataType)
    empty_edges = F.array().cast(pieces.schema["reply_network"].dataType)
    return numbered.join(pieces, ["post_id", "part"], "left").select(
        "submission",
        F.coalesce("comments", empty_comments).alias("comments"),
        F.coalesce("reply_network", empty_edges).alias("reply_network"),
        "part",
        "n_parts",
        "dump_id",
    )
