from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import DOCS, awkward, prose, sentences, table
from threadlab.llm import resampling
from threadlab.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    found = words(text)
    return [" ".join(found[i:i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def buckets(text):
    return Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text))


def plain(rows, target):
    corpus, aim = Counter(), Counter()
    for _, text in rows:
        corpus.update(buckets(text))
    for text in target:
        aim.update(buckets(text))
    s_all, t_all = sum(corpus.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000)))) for b in range(10_000)}
    out = []
    for key, text in rows:
        weight = sum(gain[b] * n for b, n in buckets(text).items())
        name = "null" if key is None else key
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(features(text)), weight, score, len(words(text)) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[:5 * len(able) // 100]
    place = {id(r): i + 1 for i, r in enumerate(drawn)}
    return Counter((r[0], r[1], r[2], r[3], place.get(id(r))) for r in out)


def test_the_query_on_the_given_texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op13_bit_sliced_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(rows, target)


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = awkward() + [(100 + i, prose(rng.randint(15, 60), i)) for i in range(150)]
    rows += [(300 + i, "Ärger ÉCOLE 你好 a_b\x7fc\x80 x" + " Ta" * 30) for i in range(20)] + [(None, prose(40, "n"))]
    target = [sentences(9, "t"), None, "", prose(30, 7), "Ärger"]
    docs = table(spark, rows).selectExpr("*", "1 AS score", "2 AS rank", "3 AS weight", "4 AS `__row`")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, bench).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == plain(rows, target)
    drawn = resampling.draw(docs, bench)
    n = sum(v for k, v in plain(rows, target).items() if k[4])
    assert drawn.columns == docs.columns and drawn.count() == n > 0


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i % 40, "la " * 30) for i in range(200)]  # five rows of each id
    bench = spark.createDataFrame([(1, "so")], "item_id long, text string")
    got = resampling.resample(table(spark, rows), bench).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11)) and Counter(r.doc_id for r in got).most_common(2)[0][1] == 5
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, bench).count() == 0
    rows = [(i, prose(30, i)) for i in range(30)]
    assert Counter(map(tuple, resampling.resample(table(spark, rows), bench).select("doc_id", "n_features", "weight", "score", "rank").collect())) == plain(rows, [])
    assert resampling.draw(empty, bench).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_crc_of_joined_strings(seed):
    rng = random.Random(seed)
    found = [bytes(rng.choices(b"abc\xc3\xa9xyz0189", k=rng.choice([1, 2, 5, 63, 64, 65, 200, 1000]))) for _ in range(60)]
    want = [zlib.crc32(b" ".join(found[i:i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(found) - n + 1)]
    assert resampling.feature_buckets(found).tolist() == want
    assert resampling.feature_buckets([]).tolist() == []


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(prose(3, i) for i in range(3000))
    whole = resampling.bucket_counts(text.encode())
    monkeypatch.setattr(resampling, "PART", 100)
    n, counts = resampling.bucket_counts(text.encode())
    assert n == whole[0] == len(words(text)) and (counts == whole[1]).all() and dict(buckets(text)) == {b: counts[b] for b in np.flatnonzero(counts).tolist()}


def test_bit_slices_give_the_exact_sum():
    rng = np.random.default_rng(6)
    gain = rng.integers(-20_000, 20_000, resampling.BUCKETS)
    sliced = resampling.Gains(gain)
    for most in (1, 2, 7, 300, 10**9):
        counts = rng.integers(0, most + 1, resampling.BUCKETS) * (rng.random(resampling.BUCKETS) < 0.3)
        assert sliced.weight(counts) == int(gain @ counts)
    assert sliced.weight(np.zeros(resampling.BUCKETS, np.int64)) == 0 and resampling.Gains(np.zeros(resampling.BUCKETS, np.int64)).weight(counts) == 0
