"""Schemas of the inputs and outputs.  They are stated, never inferred: the same column reads as
integer, double or string depending on which cells of a file are blank."""

from __future__ import annotations

# Post list at rest.  Counts are read as double because a column with blanks prints ``53000.0``.
POST_LIST_CSV = (
    "link string, id string, subreddit string, title string, upvotes string, comments string, "
    "cites string, notes string, nodes string, edges string, time string"
)
POST_COUNTS = ("upvotes", "comments", "nodes", "edges")

RAW_COMMENTS = (
    "post_id string, id string, author string, body string, score bigint, "
    "parent_fullname string, created_epoch double, seq bigint"
)

SUBMISSION = (
    "struct<id: string, title: string, url: string, score: bigint, num_comments: bigint, "
    "author: string, created_utc: string>"
)
COMMENT = (
    "struct<id: string, author: string, body: string, score: bigint, parent_id: string, "
    "depth: int, created_utc: string>"
)
EDGE = "struct<source: string, target: string, comment_id: string>"

# One thread per record; ``part`` numbers the pieces of a thread too long for one record. ``n_parts``
# and ``dump_id`` say which pieces make up one dump; both are absent (null) in dumps that never split.
THREADS = (
    f"submission {SUBMISSION}, comments array<{COMMENT}>, reply_network array<{EDGE}>, part bigint, "
    "n_parts bigint, dump_id string"
)

SCORES = "id bigint, label string, pos int, score double"
