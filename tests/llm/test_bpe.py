from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, table
from threadlab.llm import bpe
from threadlab.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def odd_texts():
    rng = random.Random(3)
    texts = [
        "", " ", "İstanbul ΣΑΣ ΟΔΟΣ ß ẞ ﬁ ǅ", "a<|endoftext|>b <|startoftext|><|endoftext|> <|ENDOFTEXT|> <| <|endoftext |>",
        "é ́x", "x y z\u0085w\x1cq\x0bq\x00", "한국어 日本語テキスト", "aaaaaaaaaaaaa" * 60, "it's'll 'S 'RE''d", "1234½²", "🙂🙂👩‍👩‍👧",
        "x" * 50_000, "ab" * 3_000 + "é" * 500, "\n" * 50_000 + "end", "</w> a</w>b",
    ]
    letters = "abcdefghijklmnopqrstuvwxyzéßüñçåøæ '.,-1"
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(1500)]
    points = [lambda: rng.randint(1, 0x2FFF), lambda: rng.randint(0x20, 0x7E), lambda: rng.randint(0x10000, 0x1FFFF)]
    return texts + ["".join(chr(rng.choice(points)()) for _ in range(rng.randint(1, 12))) for _ in range(800)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_those_of_the_library(path):
    own, theirs, texts = bpe.Tokenizer(path), library(path), odd_texts()
    assert own.sound
    if path == BYTES:
        texts = [t for t in texts if len(t) < 10_000]
    for block in (texts, texts[::-1]):  # the second time from the table
        ids, counts = own.encode([t.encode() for t in block])
        stops = np.cumsum(counts)
        for text, found, stop, n in zip(block, theirs.encode_batch(block, add_special_tokens=False), stops, counts):
            assert ids[stop - n:stop].tolist() == found.ids, text
            assert own.decode(found.ids) == theirs.decode(found.ids, skip_special_tokens=False)


def test_every_character():
    own, theirs = bpe.Tokenizer(WORDS), library(WORDS)
    texts = [chr(c) for c in range(0x3000)]
    ids, counts = own.encode([t.encode() for t in texts])
    stops = np.cumsum(counts)
    for text, found, stop, n in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), stops, counts):
        assert ids[stop - n:stop].tolist() == found.ids, hex(ord(text))


def test_only_failing_words_are_merged():
    own = bpe.Tokenizer(WORDS)
    own.encode([b"the cat and the dog"])
    assert own.tried == 4 and own.failed == 0  # "the" is one chunk
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcdefgh", k=9)).encode() for _ in range(400)})
    data = np.frombuffer(b"".join(words), np.uint8)
    ids, sizes = own.encode_words(data, np.array([len(w) for w in words]))
    assert 0 < own.failed < 400
    plain = [own.merge(own.base[[*w[:-1], w[-1] + 256]].tolist()) for w in words]
    assert ids.tolist() == [t for part in plain for t in part] and sizes.tolist() == [len(p) for p in plain]
    flat = np.concatenate([own.base[[*w[:-1], w[-1] + 256]] for w in words])
    merged, sizes = own.merge_all(flat, np.array([len(w) for w in words]))
    assert merged.tolist() == ids.tolist()


def test_compatible_pairs_are_those_that_merging_keeps():
    own = bpe.Tokenizer(WORDS)
    rng = np.random.default_rng(4)
    inner = np.flatnonzero([not t.endswith("</w>") and not t.startswith("<|") for t in own.strings])
    a, b = rng.choice(inner[:3000], 3000), rng.choice(inner[:3000], 3000)
    spelled = own._symbols()
    clash = own.clashes(a, b)
    for x, y, bad in zip(a.tolist(), b.tolist(), clash.tolist()):
        assert (own.merge(own.base[list(spelled[x] + spelled[y])].tolist()) != [x, y]) == bad
    assert 0 < clash.sum() < len(clash)


def test_a_full_table_keeps_the_most_used(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    own, theirs = bpe.Tokenizer(WORDS), library(WORDS)
    for text in ["one two three four", "three four five three six", "one two seven eight nine ten eleven", "three", "a b c"]:
        assert own.encode([text.encode()])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids
    own.encode([b"often often often"])
    own.encode([b"d e f"])
    assert b"often" in own.number and len(own.number) <= 5


def digest(ids, decoded):
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_awkward_rows(spark, tmp_path):
    theirs = library(WORDS)
    docs = table(spark).selectExpr("*", "'mine' AS ids", "5 AS decoded")
    made = bpe.decode(bpe.encode(docs, WORDS), WORDS)
    assert sorted(made.columns) == sorted(docs.columns)
    want = Counter()
    for key, text in awkward():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want[(key, *digest(ids, theirs.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter((r.doc_id, *digest(r.ids, r.decoded)) for r in made.collect()) == want
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_speculative_bpe"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    empty = spark.createDataFrame([], DOCS)
    assert bpe.decode(bpe.encode(empty, WORDS), WORDS).count() == 0


def test_the_query_on_the_given_texts(spark, sf):
    theirs = library(WORDS)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_speculative_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digest(ids, theirs.decode(ids, skip_special_tokens=False))


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows, WORDS).orderBy(F.col("doc_id")).collect()] == ["", ""]
