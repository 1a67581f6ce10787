"""Quality rules: an ordered list of threshold conjunctions learned by sequential covering.

Each rule grows condition by condition on one part of the labelled documents (best information
gain), is cut back on the other part, and takes the documents it covers out before the next rule
grows. Thresholds lie between quantiles of the bad and of the good documents that are left, so a defect
that few documents have gets some of its own. Counting is done by Spark over all labelled documents;
the driver sees one count per statistic and interval between thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.llm.common import WHITESPACE, bound, words
from threadlab.session import materialise

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
QUANTILES = [0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99]
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_COVERED = 5  # bad documents a rule must reach in either part
PRECISION = 0.9  # of a rule on the part it was not grown on

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
              "mark_share", "distinct_share"]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(tokens: Column) -> Column:
    """Words inside windows that occur at least twice in the text."""
    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

        def covered(_: Column) -> Column:
            spans = F.array_sort(
                F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("s"), i.alias("i")))
            )
            return bound(
                spans,
                lambda a: bound(
                    F.array_sort(
                        F.transform(
                            F.filter(
                                a,
                                lambda x, j: (x["s"] == F.get(a, j - 1)["s"]) | (x["s"] == F.get(a, j + 1)["s"]),
                            ),
                            lambda x: x["i"],
                        )
                    ),
                    # A start covers up to the next start, but no more than a window.
                    lambda s: F.aggregate(
                        F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW)))),
                        F.lit(0),
                        lambda acc, x: acc + x,
                    ),
                ),
            )

        # Equal windows have equal hashes, so most texts end at the first test.
        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(
            bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        )

    return bound(tokens, of)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts (long) and the ratios the rules are made of; a null text has no word."""
    lines = F.filter(F.split("body", "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).select(
        "doc_id", "body", words(F.col("body")).alias("words"), lines.alias("lines")
    )
    counted = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("body"), WHITESPACE).cast("long").alias("word_chars"),
        (F.length("body") - _without(F.col("body"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("body") - _without(F.col("body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        (F.length("body") - _without(F.col("body"), "!?=_~^+/\\{}[]@")).alias("n_marks"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    share = lambda part, whole: F.round(F.col(part) / F.greatest(F.col(whole), F.lit(1)), 6)
    return counted.select(
        "doc_id",
        *COUNTS,
        F.round(F.log2(F.col("n_words") + 1.0), 6).alias("log_words"),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:g}"


Rule = list[Condition]


def matches(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1 on; 0 if none does: one ordered CASE WHEN."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(matches(rule), F.lit(i)) if out is None else out.when(matches(rule), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


Cuts = dict[str, list[float]]


def _thresholds(rows: DataFrame) -> Cuts:
    """Half-way between neighbouring quantiles of either kind, so rules keep a distance from both."""
    found = rows.groupBy("bad").agg(*[F.percentile_approx(s, QUANTILES, 10_000).alias(s) for s in STATISTICS]).collect()
    out = {}
    for s in STATISTICS:
        values = sorted({v for row in found for v in row[s] or []})
        out[s] = sorted({round((a + b) / 2, 6) for a, b in zip(values, values[1:], strict=False)})
    return out


def _tally(rows: DataFrame, tests: dict[str, Column]) -> dict[str, tuple[int, int]]:
    """Bad and good documents under each test, in one pass."""
    found = rows.agg(
        *[F.count_if(t & F.col("bad")).alias(f"{k}_bad") for k, t in tests.items()],
        *[F.count_if(t & ~F.col("bad")).alias(f"{k}_good") for k, t in tests.items()],
    ).first()
    return {k: (found[f"{k}_bad"], found[f"{k}_good"]) for k in tests}


def _split(rows: DataFrame, cuts: Cuts) -> list[tuple[Condition, tuple[int, int]]]:
    """Every condition on one statistic with the bad and good documents it covers, in one pass: rows are
    counted by the interval their statistics fall into, and the counts added up."""
    def below(s: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[s])), lambda c: F.col(s) > c))

    place = F.explode(F.array(*[
        F.struct(F.lit(i).alias("s"), below(s).alias("k")) for i, s in enumerate(STATISTICS) if cuts[s]
    ]))
    counts = rows.select("bad", place.alias("x")).groupBy("x.s", "x.k", "bad").count().collect()
    at = {(r["s"], r["k"], r["bad"]): r["count"] for r in counts}
    out = []
    for i, s in enumerate(STATISTICS):
        for j, t in enumerate(cuts[s]):
            for above in (True, False):
                kept = range(j + 1, len(cuts[s]) + 1) if above else range(j + 1)
                covered = tuple(sum(at.get((i, k, bad), 0) for k in kept) for bad in (True, False))
                out.append((Condition(s, above, t), covered))
    return out


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """Information gained on bad documents (none left: no gain)."""
    if not after[0]:
        return 0.0
    return after[0] * (log2(after[0] / sum(after)) - log2(before[0] / sum(before)))


def grow(rows: DataFrame, cuts: Cuts) -> Rule:
    """Adds the best condition until no good document is covered or nothing is gained."""
    rule: Rule = []
    covered = _tally(rows, {"all": F.lit(True)})["all"]
    while covered[0] >= MIN_COVERED and covered[1] and len(rule) < MAX_CONDITIONS:
        found = _split(rows.where(matches(rule)), cuts)
        best = max(range(len(found)), key=lambda i: (_gain(covered, found[i][1]), -i))
        condition, reached = found[best]
        if _gain(covered, reached) <= 1e-9 or reached[0] < MIN_COVERED:
            break
        rule.append(condition)
        covered = reached
    return rule


def prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The leading conditions that do best on documents the rule has not seen."""
    found = _tally(rows, {f"p{i}": matches(rule[:i]) for i in range(1, len(rule) + 1)})
    size = max(
        range(1, len(rule) + 1),
        key=lambda i: ((found[f"p{i}"][0] - found[f"p{i}"][1]) / max(1, sum(found[f"p{i}"])), -i),
    )
    return rule[:size], *found[f"p{size}"]


def learn(rows: DataFrame, max_rules: int = MAX_RULES, precision: float = PRECISION) -> list[Rule]:
    """Rules for the rows (statistics, boolean ``bad``, boolean ``growing``), in order.

    Ends when a rule is not precise enough on the pruning part. Without rows of both kinds there
    is no rule. Ties go to the first statistic and the lowest threshold.
    """
    rules: list[Rule] = []
    rest = rows
    while len(rules) < max_rules:
        cuts = _thresholds(rest)
        rule = grow(rest.where("growing"), cuts) if any(cuts.values()) else []
        if not rule:
            break
        rule, bad, good = prune(rest.where("not growing"), rule)
        if bad < MIN_COVERED or bad < precision * (bad + good):
            break
        rules.append(rule)
        rest = rest.where(~matches(rule))
    return rules


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of documents with a quality label; a document labelled twice takes the lower one."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        (F.min("quality") == 0).alias("bad")
    )
    return stats.join(marks, "doc_id").withColumn("growing", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Every document with its counts, ``base_failed``, the number of the ``rule`` that rejects it
    (0: none) and ``kept``; and the rules.

    The rules are learned from labelled documents that pass the base test. Null and empty texts
    have no word and fail it. Repeated rows and null ids are judged like others.
    """
    stats = materialise(statistics(docs), "statistics")
    known = materialise(labelled(stats.where(~base_failed()), labels), "labelled-statistics")
    rules = learn(known)
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)),
        rules,
    )
