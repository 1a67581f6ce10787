from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows, walk
from threadlab.functions.text import bare_id
from threadlab.operators import threads
from threadlab.plans.threads import process_threads
from threadlab.session import materialise
from threadlab.sources.schemas import RAW_COMMENTS


def raw(spark, data):
    """(post, id, author, parent fullname, seq) -> landed comments."""
    full = [(p, i, a, f"text {i}", 1, parent, 1700000000.0 + s, s) for p, i, a, parent, s in data]
    return spark.createDataFrame(full, RAW_COMMENTS)


SMALL = [
    ("p", "a", "ann", "t3_p", 1), ("p", "b", "bob", "t1_a", 2), ("p", "c", None, "t1_a", 3),
    ("p", "d", "ann", "t1_b", 4), ("p", "e", "bob", "t1_d", 5), ("p", "f", "cat", "t1_c", 6),
    ("p", "g", "ann", "t1_a", 7), ("p", "h", "bob", "t1_d", 8), ("p", "i", "dan", "t3_p", 0),
    ("q", "a", "zoe", "t3_q", 1), ("q", "b", "", "t1_a", 2), ("q", "c", "zoe", "t1_b", 3),
]


def test_reply_edges(spark):
    got = rows(threads.reply_edges(raw(spark, SMALL)), "post_id", "comment_id")
    # f answers a deleted author, q/c answers an empty name: no edge.  g answers itself: an edge.
    assert got == [
        ("p", "bob", "ann", "b"), ("p", "ann", "bob", "d"), ("p", "bob", "ann", "e"),
        ("p", "ann", "ann", "g"), ("p", "bob", "ann", "h"), ("q", "", "zoe", "b"),
    ]


def test_distinct_edges_keep_the_last_comment(spark):
    got = rows(threads.distinct_edges(raw(spark, SMALL)), "post_id", "source", "target")
    assert got == [
        ("p", "ann", "ann", "g", 1), ("p", "ann", "bob", "d", 1), ("p", "bob", "ann", "h", 3),
        ("q", "", "zoe", "b", 1),
    ]


def test_network_stats(spark):
    stats = threads.reply_network_stats(threads.reply_edges(raw(spark, SMALL)))
    assert rows(stats, "post_id") == [("p", 2, 3), ("q", 2, 1)]


def random_thread(seed, n, post):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        top = i == 0 or rng.random() < 0.1
        # A third of the replies answer one comment, a tenth continue a chain.
        parent = 0 if rng.random() < 0.33 else (i - 1 if rng.random() < 0.1 else rng.randrange(max(i, 1)))
        out.append((post, f"c{i}", f"u{i % 7}", f"t3_{post}" if top else f"t1_c{parent}", i))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("hot_rows", "max_path"), [(20, 64), (1_000_000, 64), (1_000_000, 2), (50, 4)])
def test_bfs_order_equals_queue_walk(spark, hot_rows, max_path):
    data = random_thread(1, 200, "p") + random_thread(2, 60, "q") + [
        ("r", f"c{i}", "u", "t3_r" if i == 0 else f"t1_c{i - 1}", i) for i in range(70)
    ]
    order = threads.bfs_order(raw(spark, data), hot_rows, max_path).collect()
    for post in "pqr":
        comments = [
            (i, None if parent.startswith("t3") else parent[3:], s)
            for p, i, _, parent, s in data if p == post
        ]
        got = sorted((r["bfs_pos"], r["id"], r["depth"]) for r in order if r["post_id"] == post)
        assert [(i, d) for _, i, d in got] == walk(comments)
        assert [pos for pos, _, _ in got] == list(range(len(comments)))


def test_orphans_and_loops_are_kept_apart(spark):
    data = [
        ("p", "a", "x", "t3_p", 1), ("p", "b", "x", "t1_a", 2),
        ("p", "o", "x", "t1_gone", 3), ("p", "o2", "x", "t1_o", 4), ("p", "o3", "x", "t1_o2", 5),
        ("p", "l1", "x", "t1_l3", 6), ("p", "l2", "x", "t1_l1", 7), ("p", "l3", "x", "t1_l2", 8),
        ("p", "under", "x", "t1_l2", 9), ("p", "self", "x", "t1_self", 10),
    ]
    got = rows(threads.thread_paths(raw(spark, data)).select("id", "depth", "reachable"), "id")
    reachable = {i: (d, ok) for i, d, ok in got}
    assert len(got) == len(data)
    assert reachable["a"] == (0, True) and reachable["b"] == (1, True)
    assert all(v == (None, False) for k, v in reachable.items() if k not in "ab")
    assert threads.orphan_comments(raw(spark, data)).count() == 8
    assert rows(threads.bfs_order(raw(spark, data)).select("id", "bfs_pos"), "bfs_pos") == [("a", 0), ("b", 1)]


def test_paths_of_a_deep_chain_stay_short(spark):
    data = [("r", f"c{i}", "u", "t3_r" if i == 0 else f"t1_c{i - 1}", i) for i in range(150)]
    got = threads.thread_paths(raw(spark, data), max_path=8).select("id", "depth", F.size("path").alias("n"))
    assert all(r["id"] == f"c{r['depth']}" and r["n"] <= 16 for r in got.collect())


def test_siblings_without_distinct_order_numbers(spark):
    """Order numbers may repeat among cousins; parents decide first, ids break real ties."""
    data = [
        ("p", "a", "u", "t3_p", 0), ("p", "b", "u", "t3_p", 1), ("p", "a1", "u", "t1_a", 1),
        ("p", "a0", "u", "t1_a", 0), ("p", "b0", "u", "t1_b", 0), ("p", "b1", "u", "t1_b", 0),
    ]
    for max_path in (1, 64):
        order = threads.bfs_order(raw(spark, data), max_path=max_path).orderBy("bfs_pos").collect()
        assert [r["id"] for r in order] == ["a", "b", "a0", "a1", "b0", "b1"]


def test_pending_and_upsert(spark):
    posts = spark.createDataFrame(
        [("p", 1, 1, 0.5), ("q", None, None, None), ("r", 4, 5, 0.1)],
        "post_id string, nodes bigint, edges bigint, time double",
    )
    done = spark.createDataFrame([("r",), ("r",)], "post_id string")
    assert rows(threads.pending_posts(posts, done).select("post_id"), "post_id") == [("p",), ("q",)]
    stats = spark.createDataFrame([("p", 7, 8), ("x", 1, 1)], "post_id string, nodes bigint, edges bigint")
    updated = threads.upsert_post_stats(posts, stats)
    assert rows(updated, "post_id") == [("p", 7, 8, 0.5), ("q", None, None, None), ("r", 4, 5, 0.1)]


def submissions(spark, ids):
    return spark.createDataFrame(
        [(i, f"title {i}", f"u/{i}", 3, 9, None, 1700000000.0, None, None) for i in ids],
        "post_id string, title string, url string, score bigint, num_comments bigint, author string, "
        "created_epoch double, nodes bigint, edges bigint",
    )


def test_thread_documents_split_and_keep_everything(spark):
    data = random_thread(3, 90, "p") + [("q", "a", "zoe", "t3_q", 1)]
    comments, posts = raw(spark, data), submissions(spark, ["p", "q", "empty"])
    whole = threads.thread_documents(comments, posts).collect()
    assert {(d.submission.id, d.part) for d in whole} == {("p", 0), ("q", 0), ("empty", 0)}
    empty = next(d for d in whole if d.submission.id == "empty")
    assert empty.comments == [] and empty.reply_network == [] and empty.submission.author == "None"
    assert empty.submission.created_utc == "2023-11-14T22:13:20+00:00"
    p = next(d for d in whole if d.submission.id == "p")
    split = sorted(
        (d for d in threads.thread_documents(comments, posts, max_comments=25, hot_rows=20).collect()
         if d.submission.id == "p"),
        key=lambda d: d.part,
    )
    assert [len(d.comments) for d in split] == [25, 25, 25, 15]
    assert [c for d in split for c in d.comments] == p.comments
    assert [e for d in split for e in d.reply_network] == p.reply_network
    assert len(p.reply_network) == threads.reply_edges(comments).filter("post_id = 'p'").count()


def test_flatten_gives_the_comments_back(spark):
    comments = raw(spark, SMALL)
    docs = threads.thread_documents(comments, submissions(spark, ["p", "q"]))
    flat = threads.flatten_threads(docs)
    want = threads.comment_rows(comments).select(
        "post_id", "id", F.coalesce("author", F.lit("None")).alias("author"), "body", "parent_id", "created_utc"
    )
    assert rows(flat.select(*want.columns), "post_id", "id") == rows(want, "post_id", "id")
    assert threads.thread_edges(docs).count() == 6


def test_process_threads_leaves_done_posts_alone(spark):
    posts = submissions(spark, ["p", "q", "quiet"]).withColumns({"nodes": F.lit(99).cast("bigint"), "edges": F.lit(99).cast("bigint")})
    done = spark.createDataFrame([("q",)], "post_id string")
    out = process_threads(posts, raw(spark, SMALL), done)
    assert rows(out.posts.select("post_id", "nodes", "edges"), "post_id") == [
        ("p", 2, 3), ("q", 99, 99), ("quiet", 0, 0)
    ]
    assert {d.submission.id for d in out.documents.collect()} == {"p", "quiet"}


def test_links(spark):
    df = spark.createDataFrame(
        [("https://www.host.com/r/pics/comments/1gcle2b/a_title/", None, "pics", None),
         ("http://host.com/r/x/comments/4w/t/", "4w", "y", "t"), ("nonsense", "1", "s", "t")],
        "link string, post_id string, subreddit string, title string",
    )
    got = [tuple(r) for r in threads.fill_from_links(df).select("post_id", "subreddit", "title", "link_ok").collect()]
    assert got == [("1gcle2b", "pics", "a_title", True), ("4w", "y", "t", False), ("1", "s", "t", True)]


def test_parent_id_is_taken_after_the_last_underscore(spark):
    assert spark.range(1).select(bare_id(F.lit("t3_p"))).first()[0] == "p"


def test_comments_landed_twice_count_once(spark):
    data = raw(spark, SMALL)
    twice = data.unionByName(data)
    for made in (threads.bfs_order, threads.reply_edges, threads.comment_depth):
        assert sorted(rows(made(twice)), key=repr) == sorted(rows(made(data)), key=repr)


def test_loops_of_repeated_ids_end(spark):
    loop = [("p", "a", "ann", "t1_b", 1), ("p", "b", "bob", "t1_a", 2)]
    data = raw(spark, loop * 2 + SMALL[9:])
    assert rows(threads.orphan_comments(data), "id") == [("p", "a"), ("p", "b")]
    assert rows(threads.comment_depth(data).filter("post_id = 'q'"), "id") == [
        ("q", "a", 0), ("q", "b", 1), ("q", "c", 2),
    ]


def test_rounds_hold_answered_comments_only(spark, monkeypatch):
    sizes = []

    def noted(df, name, *more):
        table = materialise(df, name, *more)
        sizes.append((name, table.count()))
        return table

    monkeypatch.setattr(threads, "materialise", noted)
    order = threads.bfs_order(raw(spark, SMALL))
    assert order.count() == 12
    # a, b, c and d of p and a and b of q have answers.
    assert [n for name, n in sizes if name == "paths"][0] == 6


def test_thread_documents_read_the_landed_comments_once(spark, tmp_path):
    path = f"{tmp_path}/landed"
    raw(spark, SMALL).write.parquet(path)
    docs = threads.thread_documents(spark.read.parquet(path), submissions(spark, ["p", "q"]))
    assert docs.inputFiles() and not [f for f in docs.inputFiles() if "/landed/" in f]
    edges = docs.select(F.col("submission.id").alias("post_id"), F.explode("reply_network").alias("e"))
    got = rows(edges.select("post_id", "e.source", "e.target", "e.comment_id"), "post_id", "comment_id")
    assert got == rows(threads.reply_edges(raw(spark, SMALL)), "post_id", "comment_id")


def test_given_edges_make_the_same_documents(spark):
    comments, posts = raw(spark, SMALL), submissions(spark, ["p", "q"])
    plain = threads.thread_documents(comments, posts)
    given = threads.thread_documents(comments, posts, edges=threads.reply_edges(comments))
    assert rows(given, "submission.id") == rows(plain, "submission.id")


def test_repeated_ids_that_differ_keep_their_rules(spark):
    """Texts go by the lowest author, the tree by the lowest parent, each among rows of the lowest order number."""
    data = [("p", "a", "zoe", "t3_p", 1), ("p", "b", "bob", "t3_p", 2), ("p", "b", "cat", "t1_a", 2)]
    comments = raw(spark, data)
    doc = threads.thread_documents(comments, submissions(spark, ["p"])).first()
    assert [(c.id, c.author, c.parent_id, c.depth) for c in doc.comments] == [("a", "zoe", "p", 0), ("b", "bob", "p", 1)]
    assert [(e.source, e.target) for e in doc.reply_network] == [("cat", "zoe")]
    assert rows(threads.reply_edges(comments)) == [("p", "cat", "zoe", "b")]


def test_comments_without_keys_or_parents(spark):
    data = raw(spark, [
        ("p", "a", "ann", "t3_p", 1), ("p", "b", "bob", None, 2), ("p", "c", "cat", "t1_b", 3), ("p", None, "dan", "t1_a", 4),
        (None, "x", "eve", "t3_p", 5), (None, "y", "fay", "t1_x", 6),
    ])
    got = threads.thread_paths(data).select("post_id", "id", "depth", "reachable").collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == {
        ("p", "a"): (0, True), ("p", "b"): (0, True), ("p", "c"): (1, True), ("p", None): (1, True),
        (None, "x"): (0, True), (None, "y"): (None, False),
    }
    docs = threads.thread_documents(data, submissions(spark, ["p"])).first()
    assert [c.id for c in docs.comments] == ["a", "b", "c"]
    assert rows(threads.distinct_edges(data), "source") == [("p", "cat", "bob", "c", 1)]
