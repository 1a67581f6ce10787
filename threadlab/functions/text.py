"""Text rules as Column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.isspace() accepts, spelled so that Java regex
# and RE2 read it alike.  Neither trim() nor \s covers it.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Bodies that stand for a comment no longer there.
PLACEHOLDERS = ("[removed]", "[deleted]")

# Strings read as missing in CSV input.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(value), f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def word_count(value: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(_c(value), F.lit(f"[^{WHITESPACE}]+"))


def has_words(value: Column | str, least: int) -> Column:
    """At least that many words; unlike a count, reads no further than the last one needed."""
    if least <= 0:
        return _c(value).isNotNull()
    gap, word = f"[{WHITESPACE}]", f"[^{WHITESPACE}]"
    return F.rlike(_c(value), F.lit(f"^{gap}*+(?:{word}++{gap}++){{{least - 1}}}{word}"))


def first_words(value: Column | str, most: int) -> Column:
    """The first ``most`` words in lower case; the split stops there."""
    pieces = F.split(F.lower(_c(value)), f"[{WHITESPACE}]+", most + 2)
    return F.slice(F.filter(pieces, lambda w: w != ""), 1, most)


def letters(value: Column | str, shortest: int = 3) -> Column:
    """Lower-cased runs of ASCII letters, ``shortest`` or longer."""
    return F.regexp_extract_all(F.lower(_c(value)), F.lit(f"[a-z]{{{shortest},}}"), F.lit(0))


def normalize_label(value: Column | str) -> Column:
    """One spelling per label: stripped, lower case, ``fact-check`` hyphenated."""
    text = F.lower(strip(_c(value).cast("string")))
    text = F.replace(text, F.lit("fact_check"), F.lit("fact-check"))
    return F.replace(text, F.lit("fact check"), F.lit("fact-check"))


def normalize_topic(value: Column | str) -> Column:
    return F.lower(strip(_c(value).cast("string")))


def is_valid_comment(value: Column | str, min_words: int = 3) -> Column:
    """True for a present comment of at least ``min_words`` words; never null."""
    body = F.coalesce(_c(value), F.lit(""))
    return (
        (body != "")
        & ~F.lower(body).isin(*PLACEHOLDERS)
        & has_words(body, min_words)
    )


def safe_name(value: Column | str) -> Column:
    """Name usable in a path: slashes, spaces, colons and hyphens become underscores."""
    return F.translate(_c(value).cast("string"), "/\\ :-", "_____")


def class_key(value: Column | str) -> Column:
    return F.translate(_c(value), "-", "_")


def class_file_name(value: Column | str) -> Column:
    return F.translate(_c(value), "/ ", "__")


def null_tokens_to_null(value: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    text = _c(value)
    return F.when(~text.isin(*tokens), text)


def bare_id(fullname: Column | str) -> Column:
    """``t1_abc`` -> ``abc``."""
    return F.element_at(F.split(_c(fullname), "_"), -1)


def epoch_to_iso(epoch: Column | str) -> Column:
    """Epoch seconds as ``2024-01-01T00:00:00+00:00``; microseconds shown when not zero.

    Built on a zone-less timestamp, so the session time zone does not matter.
    """
    micros = F.round(_c(epoch).cast("double") * 1e6).cast("bigint")
    seconds = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    rest = F.pmod(micros, F.lit(1_000_000))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    wall = F.replace(F.timestamp_add("SECOND", seconds, origin).cast("string"), F.lit(" "), F.lit("T"))
    fraction = F.when(rest > 0, F.format_string(".%06d", rest)).otherwise(F.lit(""))
    return F.concat(wall, fraction, F.lit("+00:00"))
