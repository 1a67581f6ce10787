"""Input readers: stated schemas, one spelling of missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlab.functions.text import null_tokens_to_null
from threadlab.operators.labels import require_columns
from threadlab.sources.schemas import POST_COUNTS, POST_LIST_CSV, RAW_COMMENTS, THREADS

CSV = {
    "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, multi_line: bool) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).options(**CSV, multiLine=multi_line).csv(paths)


def read_posts(spark: SparkSession, paths: Mapping[str, str], multi_line: bool = False) -> DataFrame:
    """Post lists of several topics, keyed topic -> path, as one table.

    Counts may be written ``53000.0``; every column honours the same set of null spellings.
    """

    def one(topic: str, path: str) -> DataFrame:
        rows = _read_csv(spark, path, POST_LIST_CSV, multi_line)
        clean = rows.select(*[null_tokens_to_null(c).alias(c) for c in rows.columns])
        numbers = {c: F.expr(f"try_cast(try_cast(`{c}` AS double) AS bigint)") for c in POST_COUNTS}
        typed = clean.withColumns({**numbers, "time": F.expr("try_cast(`time` AS double)")})
        return typed.withColumnRenamed("id", "post_id").select(F.lit(topic).alias("topic"), "*")

    return reduce(DataFrame.unionByName, [one(t, p) for t, p in paths.items()])


def read_gold(
    spark: SparkSession,
    path: str | Sequence[str],
    text: str = "comment",
    topic: str = "topic",
    label: str = "assigned_label",
    id_col: str = "id",
    multi_line: bool = True,
) -> DataFrame:
    """Gold standard (id, comment, topic, label) from CSV.

    Comments may hold line breaks, which keeps a file from being split: land the result as Parquet
    once and work on that.
    """
    paths = [path] if isinstance(path, str) else list(path)
    header = spark.read.options(**CSV, multiLine=multi_line).csv(paths).columns
    frame = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in header))
    require_columns(frame, [id_col, text, topic, label])
    rows = _read_csv(spark, paths, ", ".join(f"`{c}` string" for c in header), multi_line)
    return rows.select(
        null_tokens_to_null(id_col).alias("id"),
        null_tokens_to_null(text).alias("comment"),
        null_tokens_to_null(topic).alias("topic"),
        null_tokens_to_null(label).alias("label"),
    )


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of label -> coarse label as rows (label, mapped)."""
    whole = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string,string>")
    return whole.select(F.explode(pairs).alias("label", "mapped"))


def read_raw_comments(spark: SparkSession, path: str) -> DataFrame:
    """Flat comment dump, one JSON object per line."""
    return spark.read.schema(RAW_COMMENTS).json(path)


def read_threads(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """Thread records: one JSON object per line, or one indented object per file."""
    return spark.read.schema(THREADS).json(path, multiLine=pretty)


def read_log(spark: SparkSession, path: str, figures: Mapping[str, str], line: str = "line") -> DataFrame:
    """Log lines of ``writers.write_log`` with ``figures`` (key -> type) as columns, null where a line
    lacks the key or holds another type; ``line`` stays, for all other keys."""
    rows = spark.read.parquet(path)
    return rows.withColumns({k: F.try_variant_get(line, f"$.{k}", kind) for k, kind in figures.items()})
