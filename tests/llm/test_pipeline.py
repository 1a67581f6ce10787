from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from tests.llm.helpers import sentences, smallest_reachable, table
from tests.llm.test_operators import plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder):
    """Documents with planted cases, labels and a benchmark."""
    item = sentences(5, "bench")
    rows = [(i, sentences(6, i) + "\nAll rights reserved by us.\n" + sentences(6, -i)) for i in range(60)]
    rows += [(100 + i, sentences(8, i) + " you stupid moron. " + sentences(3, f"t{i}")) for i in range(60)]
    rows += [(200, rows[7][1]), (201, rows[8][1] + " So."), (300, "All rights reserved by us.\n" + sentences(4, "v") + " " + item + " " + sentences(4, "w"))]
    rows += [(400, None), (401, "")]
    table(spark, rows, extra=False).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_on_its_own_input(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality"](spark, docs, folder)
    ids = {r.doc_id for r in good.collect()}
    assert ids >= {*range(60), 200, 201, 300} and not ids & {*range(100, 160)} and good.columns == COLUMNS

    lines = steps["line_dedup"](spark, good, folder)
    for r in lines.collect():
        assert "All rights" not in (r.text or "") and (r.n_chars == len(r.text or ""))
    assert lines.count() == good.count() and lines.columns == COLUMNS

    rows = [(r.doc_id, r.text) for r in lines.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = set(smallest_reachable([i for i, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4))
    one = steps["near_duplicates"](spark, lines, folder)
    assert {r.doc_id for r in one.collect()} == want and 200 not in want and one.columns == COLUMNS

    clean = steps["decontaminate"](spark, one, folder)
    assert {r.doc_id for r in clean.collect()} == want - {300} and clean.columns == COLUMNS

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in clean.collect()}
    packed = steps["pack"](spark, clean, folder).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == sizes

    whole = corpus_pipeline.run(spark, folder).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in whole} == sizes


def test_columns_with_names_of_the_operators(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder)
    names = {"kept": "'mine'", "tail": "'t'", "expected_grade": "'g'", "score": "'s'", "n_lines": "'l'", "n_dropped": "'d'", "rule": "7",
             "fingerprint": "'f'", "component_id": "'c'", "row": "1", "names": "2", "size": "3", "lost": "4", "text_key": "'k'"}
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"{v} AS {k}" for k, v in names.items()])
    steps = dict(corpus_pipeline.STAGES)
    for name in ("quality", "line_dedup", "near_duplicates", "decontaminate"):
        got = steps[name](spark, docs, folder)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        same = " AND ".join(f"{k} = {v}" for k, v in names.items())
        assert got.count() > 0 and got.where(f"NOT ({same})").count() == 0, name
    assert steps["pack"](spark, docs, folder).select("doc_id").distinct().count() == docs.count()


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder)
    steps = dict(corpus_pipeline.STAGES)
    for docs in (table(spark), table(spark).limit(0)):
        n = docs.count()
        for name in ("quality", "line_dedup"):
            assert steps[name](spark, docs, folder).count() == n, name
        for name in ("near_duplicates", "decontaminate"):
            assert steps[name](spark, docs, folder).columns == docs.columns
        assert (steps["pack"](spark, docs, folder).count() > 0) == (n > 0)
