from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tests.test_threads import SMALL, raw, submissions
from threadlab.functions.registry import CLASSES
from threadlab.operators import metrics, threads
from threadlab.plans import zero_shot
from threadlab.sources import readers, writers
from threadlab.streaming.ingest import ingest_threads, read_table


def test_post_lists_with_blanks_floats_and_commas(spark, tmp_path):
    head = "link,id,subreddit,title,upvotes,comments,cites,notes,nodes,edges,time\r\n"
    (tmp_path / "a.csv").write_text(
        head + 'u1,1a,s,t,802,80,,,,,\r\nu2,2b,s,t,53000.0,5600.0,"x, ""y"" z",note ,411,482,\r\n', newline=""
    )
    (tmp_path / "b.csv").write_text(head + "u3,3c,s,t,NaN,,n/a,,4,2,0.679\r\n", newline="")
    df = readers.read_posts(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")})
    got = rows(df.select("topic", "post_id", "upvotes", "comments", "cites", "notes", "nodes", "time"), "post_id")
    assert got == [
        ("A", "1a", 802, 80, None, None, None, None),
        ("A", "2b", 53000, 5600, 'x, "y" z', "note ", 411, None),
        ("B", "3c", None, None, None, None, 4, 0.679),
    ]
    out = str(tmp_path / "out")
    writers.write_posts(df, out)
    again = readers.read_posts(spark, {"A": out}).drop("topic")
    assert rows(again, "post_id") == rows(df.drop("topic"), "post_id")
    with pytest.raises(ValueError):
        writers.write_posts(df, out, source=out + "/")


def test_gold_with_line_breaks(spark, tmp_path):
    (tmp_path / "g.csv").write_text(
        'id,note,comment,topic,assigned_label\n1,x,"two\nlines, ""quoted""",health,Belief\n2,x,NA,health,\n'
    )
    got = rows(readers.read_gold(spark, str(tmp_path / "g.csv")), "id")
    assert got == [("1", 'two\nlines, "quoted"', "health", "Belief"), ("2", None, "health", None)]
    with pytest.raises(ValueError, match="final_label"):
        readers.read_gold(spark, str(tmp_path / "g.csv"), label="final_label")


def test_label_map(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": "x", "b c": "y"}, indent=4))
    assert rows(readers.read_label_map(spark, str(tmp_path / "m.json")), "label") == [("a", "x"), ("b c", "y")]


def test_threads_as_lines_and_indented(spark, tmp_path):
    docs = threads.thread_documents(raw(spark, SMALL), submissions(spark, ["p", "q"]))
    writers.write_threads(docs, str(tmp_path / "lines"))
    lines = readers.read_threads(spark, str(tmp_path / "lines"))
    assert rows(threads.flatten_threads(lines), "post_id", "pos") == rows(threads.flatten_threads(docs), "post_id", "pos")
    one = json.loads(docs.filter("submission.id = 'p'").toJSON().first())
    del one["part"]
    one["comments"][0]["body"] = "caffè ✅"
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2, ensure_ascii=False))
    pretty = readers.read_threads(spark, str(tmp_path / "one.json"), pretty=True)
    flat = threads.flatten_threads(pretty).collect()
    assert len(flat) == 9 and flat[0]["body"] == "caffè ✅"
    writers.write_threads(docs, str(tmp_path / "each"), per_post=True)
    assert {p.name for p in (tmp_path / "each").iterdir() if p.is_dir()} == {"post_id=p", "post_id=q"}


def test_raw_dump(spark, tmp_path):
    raw(spark, SMALL).write.json(str(tmp_path / "raw"))
    back = readers.read_raw_comments(spark, str(tmp_path / "raw"))
    assert rows(back, "post_id", "id") == rows(raw(spark, SMALL), "post_id", "id")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of keyed state starts a worker of its own in every batch."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


def test_ingest_twice_adds_nothing(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    docs = threads.thread_documents(raw(spark, SMALL), submissions(spark, ["p", "q"]), max_comments=4)
    writers.write_threads(docs.filter("submission.id = 'p'"), landing)
    ingest_threads(spark, landing, out, state)
    first = rows(read_table(spark, out, "comments"), "post_id", "id")
    assert len(first) == 9
    ingest_threads(spark, landing, out, state)
    assert rows(read_table(spark, out, "comments"), "post_id", "id") == first
    # p lands again, together with q (twice in one lot): only q is new.
    writers.write_threads(docs.unionByName(docs.filter("submission.id = 'q'")), landing)
    ingest_threads(spark, landing, out, state)
    got = rows(read_table(spark, out, "comments"), "post_id", "id")
    assert len(got) == len(SMALL) and got[:9] == first
    assert rows(read_table(spark, out, "posts").select("post_id"), "post_id") == [("p",), ("q",)]
    # A lost checkpoint reads every file again and still adds nothing.
    ingest_threads(spark, landing, out, str(tmp_path / "state2"))
    assert rows(read_table(spark, out, "comments"), "post_id", "id") == got
    edges = read_table(spark, out, "edges").select("post_id", "source", "target", "comment_id")
    want = threads.reply_edges(raw(spark, SMALL))
    assert rows(edges, "post_id", "comment_id") == rows(want, "post_id", "comment_id")


def long_thread(spark, post="p", n=6, size=2):
    data = [(post, f"c{i}", f"u{i}", f"t1_c{i - 1}" if i else f"t3_{post}", i) for i in range(n)]
    posts = spark.createDataFrame(
        [(post, "t", "u", 1, n, "a", 1.7e9, None, None)],
        "post_id string, title string, url string, score long, num_comments long, author string, "
        "created_epoch double, nodes long, edges long",
    )
    return threads.thread_documents(raw(spark, data), posts, max_comments=size)


def test_parts_of_a_thread_may_arrive_apart(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    docs = long_thread(spark)
    for lot in (docs.filter("part < 2"), docs.filter("part >= 1")):
        writers.write_threads(lot, landing)
        ingest_threads(spark, landing, out, state)
    assert rows(read_table(spark, out, "comments").select("id"), "id") == [(f"c{i}",) for i in range(6)]
    assert read_table(spark, out, "posts").count() == 1


def test_an_emptied_checkpoint_keeps_earlier_output(spark, tmp_path):
    out, state = str(tmp_path / "out"), tmp_path / "state"
    writers.write_threads(long_thread(spark, "p"), str(tmp_path / "one"))
    ingest_threads(spark, str(tmp_path / "one"), out, str(state))
    state.rename(tmp_path / "lost")
    writers.write_threads(long_thread(spark, "q"), str(tmp_path / "two"))
    ingest_threads(spark, str(tmp_path / "two"), out, str(state))
    got = read_table(spark, out, "comments").groupBy("post_id").count()
    assert rows(got, "post_id") == [("p", 6), ("q", 6)]


@pytest.mark.parametrize("size", [4, 10])
@pytest.mark.parametrize("apart", [False, True])
def test_a_thread_dumped_again_after_it_grew(spark, tmp_path, size, apart):
    """Six comments in the second dump, two of them new and at the top: one whole dump is stored."""
    def dump(ids):
        data = [("p", c, "u", "t3_p", i) for i, c in enumerate(ids)]
        posts = submissions(spark, ["p"])
        return threads.thread_documents(raw(spark, data), posts, max_comments=size)

    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    old, new = dump("abcd"), dump(["n1", "n2", *"abcd"])
    assert {r.n_parts for r in new.collect()} == {-(-6 // size)} and old.first().dump_id != new.first().dump_id
    lots = [old, new] if not apart else [new.filter("part = 0"), old.filter("part = 1"), new.filter("part > 0"), old, new]
    for lot in lots:
        writers.write_threads(lot, landing)
        ingest_threads(spark, landing, out, state)
    found = sorted(r.id for r in read_table(spark, out, "comments").collect())
    assert found == (sorted(["n1", "n2", *"abcd"]) if apart else list("abcd"))
    assert read_table(spark, out, "posts").count() == 1


def test_a_crash_between_tables(spark, tmp_path):
    landing, out, state = str(tmp_path / "landing"), tmp_path / "out", str(tmp_path / "state")
    docs = long_thread(spark)
    writers.write_threads(docs.filter("part = 0"), landing)
    ingest_threads(spark, landing, str(out), state)
    writers.write_threads(docs.filter("part > 0"), landing)
    (out / "edges").rename(tmp_path / "aside")
    (out / "edges").write_text("in the way")
    with pytest.raises(Exception, match="edges|exists|directory|mkdir"):
        ingest_threads(spark, landing, str(out), state)
    assert read_table(spark, str(out), "comments").count() == 0
    (out / "edges").rename(tmp_path / "moved")
    ingest_threads(spark, landing, str(out), state)
    assert rows(read_table(spark, str(out), "comments").select("id"), "id") == [(f"c{i}",) for i in range(6)]
    assert read_table(spark, str(out), "edges").count() == 5


def test_records_without_parts_and_broken_lines(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    whole = {"submission": {"id": "w"}, "comments": [{"id": "c"}], "reply_network": []}
    lines = [json.dumps(whole), "{broken", "{}", json.dumps({**whole, "part": 3, "n_parts": 2, "dump_id": "x"})]
    (tmp_path / "landing" / "a.json").write_text("\n".join(lines))
    out = str(tmp_path / "out")
    ingest_threads(spark, str(tmp_path / "landing"), out, str(tmp_path / "state"))
    assert rows(read_table(spark, out, "comments").select("post_id", "id")) == [("w", "c")]


def test_a_batch_that_failed_half_way_is_not_read(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), tmp_path / "out"
    writers.write_threads(long_thread(spark), landing)
    ingest_threads(spark, landing, str(out), str(tmp_path / "state"))
    (out / "parts").rename(tmp_path / "never-written")
    ingest_threads(spark, landing, str(out), str(tmp_path / "state2"))
    assert read_table(spark, str(out), "comments").count() == 6


def test_evaluation_outputs(spark, tmp_path):
    df = spark.createDataFrame(
        [("t", "belief", "belief"), ("t", "other", "belief"), ("t", "a/b c", "political")],
        "topic string, assigned_label string, pred_label_mapped string",
    )
    writers.write_evaluation(zero_shot.evaluate(df), str(tmp_path / "ev"))
    overall = spark.read.json(str(tmp_path / "ev" / "overall_metrics")).first()
    assert overall.accuracy == pytest.approx(1 / 3)
    assert overall.macro_avg.f1_score == pytest.approx((2 / 3) / 4)
    counts = metrics.confusion_counts(df, "assigned_label", "pred_label_mapped")
    cells = metrics.binary_cells(metrics.one_vs_rest_metrics(counts, grid="gold"))
    writers.write_binary_cells(cells, str(tmp_path / "bin"))
    folders = {p.name for p in (tmp_path / "bin").iterdir() if p.is_dir()}
    assert folders == {"class=a_b_c", "class=belief", "class=other"}
    assert spark.read.option("header", True).csv(str(tmp_path / "bin")).count() == 12
    stamp = writers.run_stamp(spark)
    assert len(stamp) == 15 and stamp[8] == "_"
    writers.write_metrics({"accuracy": 0.5, "loss": 1.0}, spark, str(tmp_path / "m"), "TITLE", stamp)
    text = [r[0] for r in spark.read.text(str(tmp_path / "m" / "text" / f"run_ts={stamp}")).collect()]
    assert text == ["TITLE", "=" * 50, "accuracy: 0.5", "loss: 1.0"]
    assert spark.read.json(str(tmp_path / "m" / "json")).count() == 2


def test_declared_classes_survive_the_writer(spark, tmp_path):
    df = spark.createDataFrame([("belief", "belief")], "gold string, pred string")
    wide = metrics.confusion_matrix_wide(metrics.confusion_counts(df), CLASSES)
    writers.write_csv(wide.orderBy("true_label"), str(tmp_path / "wide"))
    back = spark.read.option("header", True).csv(str(tmp_path / "wide"))
    assert back.columns == ["true_label", *CLASSES] and back.agg(F.sum("belief")).first()[0] == 1
