"""Small documents with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    rng = random.Random(seed)
    parts = ["ta", "ri", "mo", "ne", "lu", "ka", "so", "vi", "be", "do"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def sentences(n, seed):
    return " ".join(prose(8, f"{seed}-{i}").capitalize() + "." for i in range(n))


def awkward():
    """Texts by id: nulls, empty and blank ones, repeats, ties, a long one, odd characters."""
    body = sentences(12, "a")
    return [
        (1, body), (2, body), (3, body.replace("Ta", "Zu", 1)), (4, None), (5, ""), (6, " \n\t "),
        (7, "one"), (8, "one"), (9, "x" * 5000), (10, sentences(400, "long")),
        (11, sentences(3, "b") + " " + body[:400] + "\n\n" + sentences(2, "c")),
        (12, "été  \n 你好　\U0001f600 1234 <|endoftext|> it's\x0b\x1f"),
        (13, "a\nb\na\n\n" + "la la la la la " * 30), (None, body), (None, None),
        (14, sentences(4, "d")), (14, sentences(4, "d")), (14, sentences(4, "e")),
    ]


def table(spark, rows=None, extra=True):
    rows = awkward() if rows is None else rows
    made = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(made, DOCS)
    if not extra:
        return df
    # Columns whose names the operators use themselves.
    return df.selectExpr("*", "1 AS kept", "'x' AS fingerprint", "2 AS n_removed", "3 AS `names`", "4 AS `row`")


def smallest_reachable(ids, linked):
    """Per position the smallest non-null id reachable by ``linked(i, j)``."""
    n, group = len(ids), list(range(len(ids)))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for i, g in enumerate(group):
        known = [x for x in (low.get(g), ids[i]) if x is not None]
        low[g] = min(known) if known else None
    return [low[g] for g in group]
