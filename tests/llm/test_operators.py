from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, prose, sentences, smallest_reachable, table
from threadlab.llm import (
    chat, decontamination, graph, language, line_templates, ordinal, packing, rules, sentence_spans, simhash, suffixes,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- packing


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {
        t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in awkward()
    }
    got = packing.pack(table(spark).coalesce(2), TOKENIZER, block_tokens=500).toPandas()
    whole = Counter((i, len(ids[t])) for i, t in awkward() if i is not None)
    starts = got[(got.start == 0) & got.doc_id.notna()]
    assert Counter(zip(starts.doc_id.astype(int), starts.doc_tokens)) == whole
    assert got.length.sum() == sum(len(ids[t]) for _, t in awkward())
    for i, text in awkward():
        if i in (None, 14):
            continue
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids[text])
        for p in mine.itertuples():
            assert zlib.crc32(ids[text][p.start:p.start + p.length].tobytes()) == p.ids_crc32
    short = 0
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        total = int(seq.length.sum())
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and total <= 2048
        assert seq.step_group.nunique() == 1 and seq.tier.nunique() == 1
        short += total < seq.tier.iloc[0] - packing.SLACK
    assert short <= 2  # one sequence per task


def test_packing_matches_the_tokenizer_on_the_given_texts(spark, sf):
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    words = packing.Words(encode)
    odd = ["", " ", "  ", "a  b", "a   b", "\n \n", "a \nb", "a\n b", "a\n  b", "x  y", "　 z ", " lead", "trail "]
    for text in odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]:
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.id_bytes(text, encode, words) == want


def test_packing_of_long_blanks_and_special_strings(spark):
    from tokenizers import Tokenizer

    tokenizer, special = Tokenizer.from_file(TOKENIZER), packing.special_strings(TOKENIZER)
    encode = packing.encoder(TOKENIZER)
    words = packing.Words(encode)
    blanks = ["word" + " " * 2_000_000 + "end", "word" + "\n" * 2_000_000 + "end", "a\n\t" * 400_000, "\t " * 300_000 + "x", "x" * 1_000_000]
    odd = ["a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x<|endoftext|> ", "<|endoftext|", "a <|ENDOFTEXT|>"]
    for text in odd + blanks:
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.id_bytes(text, encode, words, special) == want, text[:30]
    rows = [(i, t) for i, t in enumerate(blanks[:2] + odd)]
    got = packing.pack(table(spark, rows), TOKENIZER).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


def test_steps_of_a_block_are_even():
    packer = packing.Packer(packing.TIERS, 0, 4096, 0)
    for i in range(300):
        packer.add(i, bytes(4 * (37 * i % 3000 + 1)))
    rows = [r for b in packer.flush(last=True) for r in b.to_pylist()]
    tier = {r["sequence_id"]: (r["tier"], r["step_group"]) for r in rows}
    load = Counter()
    for size, step in tier.values():
        load[step] += size
    assert max(load.values()) - min(load.values()) <= 2048


# ---- line templates


def test_template_lines_are_dropped(spark):
    rows = [(i, f"{sentences(2, i)}\nVisit number {i} of our shop today\n{sentences(1, -i)}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "Visit number 7 of our shop today"), (None, "Visit number 8 of our shop today")]
    rows += [(200 + i, sentences(2, "copy") + "\n" + sentences(2, "more")) for i in range(30)]  # copies, no template
    got = {r.doc_id: r for r in line_templates.drop_recurring(table(spark, rows)).collect()}
    for i in range(40):
        assert got[i].n_dropped == 1 and got[i].text == f"{sentences(2, i)}\n{sentences(1, -i)}"
    assert got[100].text is None and got[101].text == "" and got[102].text == "" and got[None].text == ""
    assert all(got[200 + i].n_dropped == 0 for i in range(30))
    same = line_templates.drop_recurring(table(spark))
    assert same.count() == len(awkward()) and line_templates.drop_recurring(empty(spark)).count() == 0


# ---- decision lists


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rows = awkward() + [(50, "a b c d e x a b c d e f a b c d e"), (51, "q " * 9 + "end"), (52, "#a |b| <c>\n#a |b| <c>")]
    got = rules.statistics(table(spark, rows)).select("doc_id", *rules.COUNTS).collect()
    assert Counter(map(tuple, got)) == Counter((i, *counts(t)) for i, t in rows)


def test_rules_are_learned(spark):
    rows = [(i, sentences(4, i) if i % 3 else prose(30, i).replace(" ", "## ")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    judged, found = rules.judge(table(spark, rows + [(500, None), (501, "few words")]), labels)
    got = {r.doc_id: r for r in judged.collect()}
    assert found and all(got[i].kept == (i % 3 > 0) for i in range(240))
    assert got[500].base_failed and not got[501].kept and got[500].n_words == 0
    none, no_rules = rules.judge(table(spark), labels.limit(0))
    assert not no_rules and none.count() == len(awkward())
    assert rules.judge(empty(spark), labels)[0].count() == 0


def test_a_rare_defect_gets_a_rule(spark):
    """Five in a thousand documents are full of symbols, and that is what makes them poor."""
    rows = [(i, sentences(3, i) if i % 200 else sentences(2, i).replace(" ", " <#> ")) for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 200 > 0), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    judged, found = rules.judge(table(spark, rows), labels)
    assert found and {r.doc_id for r in judged.where("NOT kept").collect()} == set(range(0, 6000, 200))


def test_interval_counts_are_those_of_the_conditions(spark):
    rows = spark.range(500).selectExpr("id % 7 = 0 AS bad", *[f"round((id * {3 + i}) % 100 / 10.0, 2) AS {s}" for i, s in enumerate(rules.STATISTICS)])
    cuts = rules._thresholds(rows)
    found = rules._split(rows, cuts)
    some = [found[i] for i in range(0, len(found), 17)]
    want = rules._tally(rows, {f"c{i}": c.column() for i, (c, _) in enumerate(some)})
    assert [want[f"c{i}"] for i in range(len(some))] == [n for _, n in some]


# ---- language


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    lengths, size = np.array([3, 1, 4]), 3
    scores, trans, start = rng.normal(size=(8, size)), rng.normal(size=(size, size)), rng.normal(size=size)
    got, pairs, first = language.forward_backward(scores, lengths, trans, start)
    at, want, moved, began = 0, [], np.zeros((size, size)), np.zeros(size)
    for n in lengths:
        paths = np.array(np.meshgrid(*[range(size)] * n, indexing="ij")).reshape(n, -1).T
        weight = np.exp([
            start[p[0]] + sum(scores[at + t, p[t]] for t in range(n)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
            for p in paths
        ])
        weight /= weight.sum()
        for t in range(n):
            want.append([weight[paths[:, t] == k].sum() for k in range(size)])
            if t:
                for p, w in zip(paths, weight):
                    moved[p[t - 1], p[t]] += w
        began += want[at]
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, moved) and np.allclose(first, began)


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs)
    got = language.identify(docs.withColumn("held_out", language.held_out()), model).toPandas()
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in language.identify(table(spark, [(1, None), (2, ""), (3, "12 ½ _"), (None, "the")]), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[None].lang_pred in model.languages
    assert language.train(empty(spark)) is None
    assert language.identify(table(spark), None).filter("lang_pred <> 'und' OR score <> 0").count() == 0
    # A text that changes its language is labelled word by word.
    by_lang = {r.lang: r.text for r in docs.where("length(text) > 400").collect()}
    mixed = by_lang["en"][:200] + " " + by_lang["de"][:200]
    _, words = language.label([mixed], model, language.Scores(model))
    best = [model.languages[k] for k in words.argmax(axis=1)]
    assert best[:10].count("en") >= 8 and best[-10:].count("de") >= 8


def test_twenty_languages_share_the_sample(spark):
    """Eighteen large ones and two of a few documents: all can be predicted."""
    def text(lang, i):
        rng = random.Random(f"{lang}-{i}")
        parts = [chr(97 + (lang * 5 + k) % 26) + chr(97 + (lang + 3 * k) % 26) for k in range(6)]
        return " ".join("".join(rng.choices(parts, k=3)) for _ in range(25))

    rows = [(lang * 1000 + i, text(lang, i), f"l{lang:02}") for lang in range(20) for i in range(60 if lang < 18 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample=80)
    assert model.languages == [f"l{i:02}" for i in range(20)]
    got = language.identify(docs.withColumn("held_out", language.held_out()), model).where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9


def test_long_texts_lend_a_bounded_number_of_chains(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda docs: seen.extend(docs))
    rows = [(i, "\n".join(prose(4, f"{i}-{k}") for k in range(3000)), "en") for i in range(3)]
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen and all(len(found) == language.CHAINS for _, found in seen)


def test_awkward_rows_are_identified(spark, sf):
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = table(spark).selectExpr("*", "1 AS lang_pred", "'x' AS score")
    got = language.identify(docs, model)
    assert got.count() == len(awkward()) and got.where("score < 0 OR score > 1 OR lang_pred IS NULL").count() == 0
    assert language.identify(empty(spark), model).count() == 0


# ---- ordinal


def test_ordinal_gradient_equals_finite_differences():
    rng = np.random.default_rng(9)
    n, k = 40, 12
    owner = np.repeat(np.arange(n), 3)
    flat, grades = rng.integers(0, k, 3 * n), rng.integers(0, 4, n)
    theta, prior = rng.normal(size=k + 3) * 0.5, rng.normal(size=3)
    loss, gradient = ordinal.loss_and_gradient(theta, flat, owner, grades, k, prior)
    for i in range(k + 3):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (ordinal.loss_and_gradient(up, flat, owner, grades, k, prior)[0] - ordinal.loss_and_gradient(down, flat, owner, grades, k, prior)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, rel=1e-4, abs=1e-7)
    assert loss > 0


def test_ratings_equal_the_plain_version(spark):
    """Scores, grades and decisions of every row from the weights alone."""
    rows = awkward() + [(100 + i, sentences(3, i) + (" you stupid moron." if i % 3 else "")) for i in range(90)]
    labels = spark.createDataFrame([(100 + i, 1, int(i % 3 > 0)) for i in range(90)] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + [(101, "another text of this id")])
    model = ordinal.train(docs, labels)
    got = Counter()
    for r in ordinal.rate(docs, model).collect():
        got[(r.doc_id, round(r.expected_grade, 4), round(r.tail, 4), r.kept)] += 1
    want, known = Counter(), ordinal.Features()
    for key, text in rows + [(101, "another text of this id")]:
        score = sum(model.weights[i] for i in set(ordinal.features(text, known).tolist()))
        low = [1 / (1 + np.exp(-(t - score))) for t in model.thresholds]
        expected = sum(k * (b - a) for k, (a, b) in enumerate(zip([0, *low], [*low, 1])))
        want[(key, round(float(expected), 4), round(float(1 - low[-1]), 4), bool(1 - low[-1] >= ordinal.KEEP))] += 1
    assert sum((got - want).values()) <= 2  # rounding at the fourth place
    assert sum(got.values()) == sum(want.values())


# ---- ordinal, order


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(3)
    rows, grades = [], []
    for i in range(300):
        g = i % 3
        rows.append(np.unique(np.array([g * 10 + rng.integers(3), 100 + rng.integers(20)], np.int32)))
        grades.append(g)
    model = ordinal.fit(rows, np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    expected, tail = model.grades(np.array([model.score(r) for r in rows]))
    means = [expected[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2] and tail[np.array(grades) == 2].min() > tail[np.array(grades) == 0].max()


def test_toxic_and_poor_documents_go(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # labels enough to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = ordinal.train(docs, labels)
    got = ordinal.rate(docs, model).join(labels, "doc_id").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert got[good].kept.mean() > 0.95 and got[~good].kept.mean() < 0.1
    assert ordinal.rate(table(spark), model).count() == len(awkward())
    unlabelled = ordinal.train(docs, labels.limit(0))
    assert ordinal.rate(table(spark), unlabelled).filter("NOT kept").count() == 0
    assert ordinal.rate(empty(spark), model).count() == 0


# ---- string tiling


def plain_tiles(a, b, least):
    """Marks the longest common run again and again."""
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while (i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]
                       and not used_a[i + k] and not used_b[j + k]):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        for k in range(best[0]):
            used_a[best[1] + k] = used_b[best[2] + k] = True
        total += best[0]


@pytest.mark.parametrize("seed", range(12))
def test_tiling_marks_what_the_plain_version_marks(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(1, 40, 60)
    doc = np.concatenate([item[30:50], rng.integers(1, 40, 7), item[:25], item[52:]])
    made = decontamination.tiles(item, doc, 5, decontamination.Powers())
    assert sum(t[2] for t in made) == plain_tiles(item.tolist(), doc.tolist(), 5)
    assert all((item[i:i + n] == doc[j:j + n]).all() for i, j, n in made)


def test_contaminated_documents(spark):
    item = sentences(5, "bench")
    halves = item.split(". ")
    moved = ". ".join(halves[3:] + halves[:3])  # reordered
    rows = [(i, sentences(20, i)) for i in range(20)] + [
        (30, sentences(3, "x") + " " + item), (31, sentences(3, "y") + " " + moved), (32, halves[0]), (33, item),
        (33, item), (None, item),
    ]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, item)], "item_id long, text string")
    docs = table(spark, rows + awkward()[3:8])
    got = Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect())
    assert got == Counter({(d, i): n for d, n in ((30, 1), (31, 1), (33, 2), (None, 1)) for i in (1, 5)})
    assert decontamination.drop_contaminated(docs, bench).count() == 20 + 1 + 5
    assert decontamination.contaminated(empty(spark), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_repeated_words_are_no_quadratic_work():
    start = time.perf_counter()
    for i, j in ((400, 8_000), (2_000, 60_000)):
        made = decontamination.tiles(np.full(i, 7, np.uint64), np.full(j, 7, np.uint64), 5, decontamination.Powers())
        assert made == [(0, 0, i)]
    assert time.perf_counter() - start < 2


@pytest.mark.parametrize("seed", range(8))
def test_tiling_of_few_different_words(seed):
    rng = np.random.default_rng(seed)
    item, doc = rng.integers(1, 3, 30).astype(np.uint64), rng.integers(1, 3, 60).astype(np.uint64)
    made = decontamination.tiles(item, doc, 5, decontamination.Powers())
    assert sum(t[2] for t in made) == plain_tiles(item.tolist(), doc.tolist(), 5)
    assert all((item[i:i + n] == doc[j:j + n]).all() for i, j, n in made)


def test_short_items(spark):
    bench = spark.createDataFrame(
        [(1, "Four words, right here"), (2, "just three words"), (3, "two words"), (4, "one"), (5, "?!"), (6, None)], "item_id long, text string"
    )
    rows = [
        (1, "Prose with four words right here inside."), (2, "four words right there"), (3, "It is just three words long."),
        (4, "There are two words in it."), (5, "head\nTwo words!\ntail"), (6, "One."), (7, "one two"), (8, "two\nwords"), (9, "two words one"),
    ]
    got = {(r.doc_id, r.item_id, r.n_tiles, r.n_matched) for r in decontamination.contaminated(table(spark, rows), bench).collect()}
    assert got == {(1, 1, 1, 4), (3, 2, 1, 3), (5, 3, 1, 2), (6, 4, 1, 1)}


def test_an_item_that_fills_the_benchmark(spark):
    item = sentences(6, "hot")
    bench = spark.createDataFrame([(i, item if i % 2 else sentences(6, f"b{i}")) for i in range(200)], "item_id long, text string")
    rows = [(i, sentences(3, i) + " " + item if i % 3 == 0 else sentences(9, f"d{i}")) for i in range(30)]
    got = Counter(r.doc_id for r in decontamination.contaminated(table(spark, rows), bench).collect())
    assert got == {i: 100 for i in range(0, 30, 3)}


def plain_coverage(text, item, least=5):
    a, b = decontamination.words(item), decontamination.words(text)
    return plain_tiles(a, b, least) / len(a) if a else 0.0


def test_contamination_against_the_plain_version(spark):
    rng = random.Random(8)
    bench = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(5, 30)))) for i in range(12)]
    rows = []
    for i in range(25):
        cut = " ".join(rng.choice(bench)[1].split()[rng.randint(0, 8):][:rng.randint(3, 25)])
        rows.append((i, " ".join([*rng.choices("abcdefghxyz", k=15), cut, *rng.choices("klmnop", k=9)])))
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.contaminated(
        table(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {(i, k): c for i, t in rows for k, item in bench if (c := plain_coverage(t, item)) >= 0.5}
    assert want and got == pytest.approx(want)


# ---- suffix arrays


def plain_removal(rows):
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        mark = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                mark[i:i + 100] = True
            seen.add(data[i:i + 100])
        kept = np.frombuffer(data, np.uint8)[~mark].tobytes()
        edges = np.diff(np.concatenate([[0], mark.view(np.int8)]))
        out[key, text] = (len(data), int(mark.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [suffixes.SHARD, 300])
def test_repeated_bytes(spark, shard):
    shared = sentences(6, "shared")
    rows = [r for r in awkward() if r[0] not in (None, 14)] + [(20 + i, prose(20, i) + shared + prose(20, -i)) for i in range(25)]
    rows += [(60, "\x00" * 300), (61, "ab" * 90), (62, "z" * 99), (63, shared[:100]), (64, shared[:99])]
    want = plain_removal(rows)
    got = suffixes.removal_digests(table(spark, rows + rows[:3]), shard, 50).collect()
    assert len(got) == len(rows) + 3
    texts = dict(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, texts[r.doc_id]], r.doc_id
    assert suffixes.removal_digests(empty(spark)).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in (1, 40, 40, 200)] + [b"\0" * 50, b"\0" * 50]
    sizes = np.array([len(t) for t in texts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    data = b"".join(texts)
    want = sorted(range(len(data)), key=lambda i: (data[i:ends[i]], i))
    assert suffixes.suffix_array(np.frombuffer(data, np.uint8), ends).tolist() == want


# ---- chat


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "bye")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (7, 3)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 10, "user", "hi"), (6, 10, "user", "hi")]
    rows += [(None, None, "user", "alone"), (None, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "2 AS k")
    got = {r.conv_id: (r.n_turns, r.n_snapshots) for r in chat.render(df).collect()}
    assert got == {2: (4, 2), 5: (2, 1), None: (2, 1)}
    text = chat.render(df).filter("conv_id = 2").first().text
    assert text == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\n\n<|user|>\nbye\n"
    assert chat.render(df.limit(0)).count() == 0


# ---- simhash


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    rows = awkward() + [(70 + i, sentences(40, "near") + f" tail {i}") for i in range(12)]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = smallest_reachable([i for i, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = simhash.near_duplicates(table(spark, rows)).collect()
    mine = Counter((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in got)
    assert mine == Counter((i, p, c) for (i, _), p, c in zip(rows, prints, want))
    kept = simhash.keep_one(table(spark, rows))
    # Both texts with id 14 stand for a group of their own.
    assert kept.count() == len(set(want)) + 1 and kept.columns == table(spark).columns
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("batch", [10**7, 2000])
def test_every_link_within_the_distance_is_found(batch):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 4, 5, 6)]
    prints = np.unique(np.concatenate([centres, *[centres ^ np.uint64(f) for f in flips]])).view(np.int64)
    found = set()
    for bucket in range(16):
        near = np.bitwise_count((prints.view(np.uint64) >> np.uint64(60)) ^ np.uint64(bucket)) <= 2
        found |= {tuple(p) for p in simhash.bucket_links(prints[near], bucket, 4, 4, batch).tolist()}
    index = {p: i for i, p in enumerate(prints.tolist())}
    pairs = {(index[a], index[b]) for a, b in found} | {(index[b], index[a]) for a, b in found}
    far = np.bitwise_count(prints.view(np.uint64)[:, None] ^ prints.view(np.uint64)[None, :])
    ids = list(range(len(prints)))
    assert smallest_reachable(ids, lambda i, j: (i, j) in pairs) == smallest_reachable(ids, lambda i, j: far[i, j] <= 4)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


# ---- sentences


def plain_spans(rows, run=2, least=10, alone=20):
    """Every run that is long enough, of any length, and starts earlier."""
    first, texts = {}, []
    for key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        pieces = re.findall(sentence_spans.PIECE, text or "")
        clean, gone = [p.strip(" \t\r\n") for p in pieces], set()
        sizes = [len(re.split(sentence_spans.BLANK, s)) if s else 0 for s in clean]
        for i in range(len(clean)):
            for j in range(i + 1, min(len(clean), i + 12) + 1):  # longer runs are made of these
                words = sum(sizes[i:j])
                if (j - i >= run and words >= least) or (j - i == 1 and (words >= alone or len(clean) == 1 and words >= least)):
                    if first.setdefault(tuple(clean[i:j]), (key, text, i)) != (key, text, i):
                        gone |= set(range(i, j))
        kept = "".join(p for i, p in enumerate(pieces) if i not in gone)
        texts.append((key, len(pieces), len(gone), text if text is None else kept))
    return texts


def test_repeated_sentences(spark):
    rows = [r for r in awkward() if r[0] not in (None, 14)] + [(None, sentences(12, "a"))]
    rows += [(40, "One sentence of ten words that stands all by itself."), (41, "One sentence of ten words that stands all by itself.")]
    got = sentence_spans.drop_repeated(table(spark, rows)).select("doc_id", "n_sentences", "n_removed", "text")
    assert Counter(map(tuple, got.collect())) == Counter(plain_spans(rows))
    assert sentence_spans.drop_repeated(table(spark)).count() == len(awkward())
    assert sentence_spans.drop_repeated(empty(spark)).count() == 0


def test_columns_of_documents_survive(spark):
    docs = table(spark)
    for made in (simhash.keep_one(docs), decontamination.drop_contaminated(docs, docs.limit(0).withColumnRenamed("doc_id", "item_id"))):
        assert made.columns == docs.columns
    assert line_templates.drop_recurring(docs).select(*docs.columns).where(F.col("kept") != 1).count() == 0
