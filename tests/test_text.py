from __future__ import annotations

import sys

from pyspark.sql import functions as F

from threadlab.functions import scores, text

SPACES = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]


def test_every_space_splits_and_strips(spark):
    assert len(SPACES) == 29
    data = [(i, f"{s}ab{s}c{s}{s}d{s}") for i, s in enumerate(SPACES)]
    df = spark.createDataFrame(data, "i int, t string")
    got = df.select("t", text.word_count("t").alias("n"), text.strip("t").alias("s"), text.first_words("t", 9).alias("w"))
    for t, n, s, w in got.collect():
        assert (n, s, w) == (len(t.split()), t.strip(), t.split())


def test_word_limits(spark):
    data = ["", "  ", "a", " a b", "a b ", "a\u00a0b\x1cc", "\n a  b\tc d e "]
    df = spark.createDataFrame([(x,) for x in data], "t string")
    for n in range(0, 7):
        for t, has, first in df.select("t", text.has_words("t", n), text.first_words("t", n)).collect():
            assert has == (len(t.split()) >= n) and first == t.split()[:n]


def test_normalize_label_order(spark):
    data = ["  Fact_Check\n", "fact check", "FACT-CHECK", "a fact_check b fact check", "Belief ", "fact_ check"]
    df = spark.createDataFrame([(x,) for x in data], "x string")
    got = [r[0] for r in df.select(text.normalize_label("x")).collect()]
    assert got == ["fact-check", "fact-check", "fact-check", "a fact-check b fact-check", "belief", "fact_ check"]


def test_valid_comment(spark):
    cases = {
        None: False, "": False, "[removed]": False, "[ReMoved]": False, "[Deleted]": False, "   ": False,
        "two words": False, "one two three": True, "a b c": True, "[removed] by a bot": True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r[0]: (r[1], r[2]) for r in df.select("c", text.is_valid_comment("c"), text.is_valid_comment("c", 1)).collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    # With one word enough, only the placeholder rule keeps a removed comment out.
    assert not got["[ReMoved]"][1] and not got["   "][1] and got["two words"][1]


def test_names_and_ids(spark):
    row = spark.range(1).select(
        text.safe_name(F.lit("a/b\\c d:e-f")), text.class_key(F.lit("fact-check")),
        text.class_file_name(F.lit("a/b c-d")), text.bare_id(F.lit("t1_abc")), text.bare_id(F.lit("abc")),
    ).first()
    assert tuple(row) == ("a_b_c_d_e_f", "fact_check", "a_b_c-d", "abc", "abc")


def test_iso_time_in_any_zone(spark):
    from datetime import datetime, timezone

    epochs = [0.0, 1700000000.0, 1700000000.25, 951782400.0, -1.0, 1711846800.0]
    df = spark.createDataFrame([(e,) for e in epochs], "e double")
    want = [datetime.fromtimestamp(e, tz=timezone.utc).isoformat() for e in epochs]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Rome", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [r[0] for r in df.select(text.epoch_to_iso("e")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_null_tokens(spark):
    df = spark.createDataFrame([("",), ("NaN",), ("n/a",), ("None",), ("none",), ("x",)], "x string")
    got = [r[0] for r in df.select(text.null_tokens_to_null("x")).collect()]
    assert got == [None, None, None, None, "none", "x"]


def test_score_expressions(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "s array<double>")
    soft, label, zero = df.select(
        scores.softmax(F.col("s")), scores.pick_label(["a", "b", "c"], F.col("s")),
        scores.ratio(F.lit(1), F.lit(0)),
    ).first()
    assert soft == [0.5, 0.5, 0.0] and label == "a" and zero == 0.0
