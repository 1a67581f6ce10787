from __future__ import annotations

import random
import re

from tests.llm.helpers import prose, sentences, table
from threadlab.llm import sentence_spans


def removed(spark, rows):
    return {r.doc_id: (r.n_removed, r.text) for r in sentence_spans.drop_repeated(table(spark, rows)).collect()}


def plain(rows):
    """Every sentence of every run that is long enough and starts earlier, of any length."""
    first, texts = {}, {}
    for key, text in rows:
        pieces = re.findall(sentence_spans.PIECE, text)
        texts[key] = pieces, [p.strip(" \t\r\n") for p in pieces], set()
    for key, (_, clean, gone) in sorted(texts.items()):
        for i in range(len(clean)):
            for j in range(i + 1, len(clean) + 1):
                n = len(" ".join(clean[i:j]).split())
                if (j - i >= 2 and n >= 10) or (j - i == 1 and n >= 20):
                    if first.setdefault(tuple(clean[i:j]), (key, i)) != (key, i):
                        gone |= set(range(i, j))
    return {k: (len(g), "".join(p for i, p in enumerate(ps) if i not in g)) for k, (ps, _, g) in texts.items()}


def test_short_sentences_in_a_row(spark):
    verse = "\n".join(prose(3, f"verse{i}") for i in range(30))
    got = removed(spark, [(i, f"{sentences(2, i)}\n{verse}\n{sentences(2, -i)}") for i in range(1, 4)])
    assert [got[i][0] for i in (1, 2, 3)] == [0, 30, 30]


def test_a_long_sentence_between_different_neighbours(spark):
    long = prose(25, "long") + "."
    got = removed(spark, [(i, f"{sentences(2, i)} {long} {sentences(2, -i)}") for i in range(1, 4)])
    assert got[1][0] == 0 and [got[i] for i in (2, 3)] == [(1, f"{sentences(2, i)} {sentences(2, -i)}") for i in (2, 3)]


def test_runs_of_any_length(spark):
    rng = random.Random(5)
    pool = [prose(rng.choice([1, 1, 2, 3, 8, 25]), f"s{i}") + rng.choice(". ! \n".split(" ")) for i in range(25)]
    rows = []
    for i in range(60):
        k = rng.randrange(20)
        rows.append((i, " ".join([*rng.choices(pool, k=rng.randrange(1, 5)), *pool[k:k + rng.randrange(9)], *rng.choices(pool, k=3)])))
    assert removed(spark, rows) == plain(rows)
