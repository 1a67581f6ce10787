"""From landed comments to thread records, reply networks and the updated post list."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from threadlab.operators import threads
from threadlab.session import materialise


@dataclass
class ThreadTables:
    """``comments`` are the pending ones, written once; ``documents`` are built when first asked for."""

    comments: DataFrame
    pending: DataFrame
    edges: DataFrame
    stats: DataFrame
    posts: DataFrame

    @cached_property
    def documents(self) -> DataFrame:
        return threads.thread_documents(self.comments, self.pending, edges=self.edges)


def process_threads(posts: DataFrame, raw: DataFrame, done: DataFrame | None = None) -> ThreadTables:
    """All pending posts in one job.

    ``posts`` needs post_id, title, url, score, num_comments, author, created_epoch, nodes, edges.
    ``done`` lists the post_ids already processed; only comments of the other posts are worked on.
    """
    pending = posts if done is None else threads.pending_posts(posts, done)
    comments = raw if done is None else materialise(threads.comments_of(raw, pending), "pending")
    edges = materialise(threads.reply_edges(comments), "edges")
    stats = threads.reply_network_stats(edges)
    # A thread nobody answered in has an empty network, not an unknown one.
    stats = pending.select("post_id").join(stats, "post_id", "left").fillna(0, ["nodes", "edges"])
    return ThreadTables(
        comments=comments,
        pending=pending,
        edges=edges,
        stats=stats,
        posts=threads.upsert_post_stats(posts, stats),
    )
