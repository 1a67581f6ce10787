from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tests.test_sources import SMALL, raw, submissions
from threadlab.operators import threads
from threadlab.sources import files, readers


def documents(spark, size=10_000):
    return threads.thread_documents(raw(spark, SMALL), submissions(spark, ["p", "q"]), max_comments=size)


def test_one_file_per_thread(spark, tmp_path):
    path = str(tmp_path / "threads")
    assert files.read_manifest(spark, path).count() == 0
    files.write_thread_files(documents(spark), path)
    assert sorted(p.name for p in (tmp_path / "threads").iterdir()) == ["manifest", "p.json", "q.json"]
    one = json.loads((tmp_path / "threads" / "p.json").read_text())
    assert list(one) == ["submission", "comments", "reply_network"] and len(one["comments"]) == 9
    assert (tmp_path / "threads" / "p.json").read_text().startswith('{\n  "submission": {\n    "id": "p"')
    back = threads.flatten_threads(readers.read_threads(spark, f"{path}/*.json", pretty=True))
    assert rows(back, "post_id", "pos") == rows(threads.flatten_threads(documents(spark)), "post_id", "pos")
    done = files.read_manifest(spark, path)
    assert rows(done.select("post_id")) == [("p",), ("q",)]
    posts = submissions(spark, ["p", "q", "r"])
    assert rows(threads.pending_posts(posts, done).select("post_id")) == [("r",)]


def test_records_of_a_split_thread(spark, tmp_path):
    path = str(tmp_path / "threads")
    docs = documents(spark, 4)
    files.write_thread_files(docs.where("part = 0"), path)
    assert {r.post_id for r in files.read_manifest(spark, path).collect()} == {r.id for r in docs.where("n_parts = 1").select("submission.id").collect()}
    files.write_thread_files(docs.where("part > 0"), path)
    assert {r.post_id for r in files.read_manifest(spark, path).collect()} == {"p", "q"}
    assert (tmp_path / "threads" / "p.part-00002.json").exists()


def test_a_failed_task_leaves_no_visible_file(spark, tmp_path):
    path = tmp_path / "threads"
    docs = documents(spark).repartition(2, F.col("submission.id"))
    bad = docs.withColumn("part", F.when(F.col("submission.id") == "q", F.raise_error(F.lit("broken"))).otherwise(F.col("part")))
    with pytest.raises(Exception, match="broken"):
        files.write_thread_files(bad, str(path))
    left = [p.name for p in path.rglob("*")] if path.exists() else []
    assert not [n for n in left if n.endswith(".json")]
    files.write_thread_files(docs, str(path))
    files.write_thread_files(docs.where("submission.id = 'q'"), str(path))  # again: replaced
    assert sorted(p.name for p in path.iterdir() if p.name.endswith(".json")) == ["p.json", "q.json"]


def test_odd_names(spark, tmp_path):
    docs = documents(spark).where("submission.id = 'p'").withColumn("submission", F.col("submission").withField("id", F.lit("a/b ü")))
    files.write_thread_files(docs, str(tmp_path / "x"))
    assert rows(files.read_manifest(spark, str(tmp_path / "x")).select("post_id")) == [("a/b ü",)]
    assert [p.name for p in (tmp_path / "x").glob("*.json")] == ["a%2Fb%20%C3%BC.json"]


def test_records_become_objects_one_at_a_time(tmp_path, monkeypatch):
    """A batch of long records is never turned into Python objects as a whole."""
    made = pa.RecordBatch.from_pylist([{"submission": {"id": f"t{i}"}, "comments": [{"id": "c"}], "part": 0, "n_parts": 1, "dump_id": "d"} for i in range(5)])

    class Batch:
        num_rows = made.num_rows

        def slice(self, at, n):
            assert n == 1
            return made.slice(at, n)

    written = files.ThreadFilesWriter(str(tmp_path / "x")).write(iter([Batch()]))
    assert [f["file"] for f in written.files] == [f"t{i}.json" for i in range(5)] and {f["dump_id"] for f in written.files} == {"d"}
