"""Output tables.  Writers create their folders; nothing overwrites its own input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlab.functions.text import class_file_name
from threadlab.operators.metrics import binary_cells, wide_matrix
from threadlab.sources.schemas import POST_LIST_CSV

CSV = {
    "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def run_stamp(spark: SparkSession) -> str:
    """One ``yyyyMMdd_HHmmss`` stamp per run, taken once."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_threads(documents: DataFrame, path: str, per_post: bool = False, mode: str = "append") -> None:
    """Thread records, one JSON line each; ``per_post`` gives every post a folder of its own.

    Leave ``per_post`` off for very many posts: a folder each is a burden on any file system.
    """
    if per_post:
        keyed = documents.withColumn("post_id", F.col("submission.id"))
        keyed.write.mode(mode).partitionBy("post_id").json(path)
    else:
        documents.write.mode(mode).json(path)


def write_posts(posts: DataFrame, path: str, source: str | None = None) -> None:
    """Updated post list, to a new path (the rows are still being read from ``source``)."""
    if source is not None and path.rstrip("/") == source.rstrip("/"):
        raise ValueError("write to a new path, then swap")
    names = [c.split()[0] for c in POST_LIST_CSV.split(", ")]
    rows = posts.withColumnRenamed("post_id", "id").withColumn("time", F.round("time", 3))
    write_csv(rows.select(*names), path)


def write_metrics(values: Mapping[str, float], spark: SparkSession, path: str, title: str, stamp: str) -> None:
    """A metric set as JSON rows and as readable text, under a stamp of the run."""
    rows = spark.createDataFrame(
        [(i, k, float(v)) for i, (k, v) in enumerate(values.items())], "pos int, key string, value double"
    )
    write_json(rows.select("key", "value"), f"{path}/json/run_ts={stamp}")
    head = spark.createDataFrame([(-2, title), (-1, "=" * 50)], "pos int, line string")
    lines = rows.select("pos", F.format_string("%s: %s", "key", F.col("value").cast("string")).alias("line"))
    text = head.unionByName(lines).coalesce(1).sortWithinPartitions("pos").select("line")
    text.write.text(f"{path}/text/run_ts={stamp}")


def overall_metrics(averages: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Averages as the nested record (accuracy, macro_avg{...}, weighted_avg{...})."""

    def block(kind: str):
        parts = [F.col(f"{kind}_{m}").alias("f1_score" if m == "f1" else m) for m in ("precision", "recall", "f1")]
        return F.struct(*parts).alias(f"{kind}_avg")

    return averages.select(*group, "accuracy", block("macro"), block("weighted"))


def write_evaluation(evaluation, path: str, group: Sequence[str] = ("topic",)) -> None:
    """Report (CSV and JSON), matrix, class table (CSV) and overall figures (JSON)."""
    write_csv(evaluation.report, f"{path}/classification_report_csv")
    write_json(evaluation.report, f"{path}/classification_report_json")
    write_csv(evaluation.matrix, f"{path}/confusion_matrix")
    write_csv(evaluation.per_class, f"{path}/per_class_metrics")
    write_json(overall_metrics(evaluation.averages, group), f"{path}/overall_metrics")


LABELLED = ("id", "topic", "comment", "assigned_label", "pred_label", "pred_label_mapped", "pred_score")


def write_labelled(labelled: DataFrame, path: str) -> None:
    """The labelled gold rows as CSV."""
    write_csv(labelled.select(*LABELLED), path)


def write_binary_cells(cells: DataFrame, path: str) -> None:
    """One folder of four counts per class; classes that share a file name share its folder."""
    named = cells.withColumn("class", class_file_name("class"))
    named.write.options(**CSV).partitionBy("class").csv(path)


def write_history(history: DataFrame, path: str, keys: Sequence[str] = ("experiment_name", "model_key", "fold")) -> None:
    """History lines, one row per epoch and one per step, as CSV and JSON; figures a line lacks stay empty."""
    names = [r[0] for r in history.select("key").distinct().orderBy("key").collect()]
    wide = history.groupBy(*keys, "epoch", "step").pivot("key", names).agg(F.first("value"))
    write_csv(wide, f"{path}/csv")
    write_json(wide, f"{path}/json")


def write_workflow(result, spark: SparkSession, path: str) -> None:
    """Everything a single-topic run reports: history, metrics, report, matrices, errors."""
    stamp = run_stamp(spark)
    write_history(result.history, f"{path}/training_history")
    write_log(history_lines(result.history), f"{path}/training_log")
    write_metrics(result.validation, spark, f"{path}/validation_metrics", "VALIDATION SET RESULTS", stamp)
    write_metrics(result.test, spark, f"{path}/test_metrics", "TEST SET RESULTS", stamp)
    write_json(result.report, f"{path}/classification_report/run_ts={stamp}")
    write_csv(wide_matrix(result.matrix, result.classes, value="share"), f"{path}/confusion_matrix_normalized")
    write_csv(result.errors, f"{path}/error_analysis")
    write_csv(result.one_vs_rest, f"{path}/binary_confusion_matrices_summary")
    write_binary_cells(binary_cells(result.one_vs_rest), f"{path}/binary_confusion_matrices")


def land(df: DataFrame, path: str, partition_by: Sequence[str] = ("topic",), mode: str = "append") -> None:
    """Land a parsed input as Parquet by topic, so that later reads prune folders and columns."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


RUN = ["experiment_name", "model_key", "fold"]


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predicted rows as CSV, a folder for each run."""
    predictions.write.options(**CSV).partitionBy(*RUN).csv(path)


def write_reports(report: DataFrame, path: str) -> None:
    """Report rows as JSON, a folder for each run."""
    report.write.partitionBy(*RUN).json(path)


def write_log(lines: DataFrame, path: str, line: str = "line") -> None:
    """Log lines whose keys differ, as they are: column ``line`` (a JSON object each) becomes a VARIANT.

    Keys, strings, nulls and nesting stay; a line that is no JSON becomes null.
    """
    lines.withColumn(line, F.try_parse_json(line)).write.parquet(path)


def write_cv(result, path: str) -> None:
    """Predictions, fold metrics, reports, summary and history of a cross-validated run."""
    write_predictions(result.predictions, f"{path}/predictions")
    write_reports(result.report, f"{path}/reports")
    keys = ["experiment_name", "model_key", "model_name"]
    names = [r[0] for r in result.fold_metrics.select("metric").distinct().orderBy("metric").collect()]
    folds = result.fold_metrics.groupBy(*keys, "fold").pivot("metric", names).agg(F.first("value"))
    write_csv(folds.orderBy(*keys, "fold"), f"{path}/all_folds_metrics")
    pair = [F.first("mean").alias("mean"), F.first("std").alias("std")]
    write_csv(
        result.summary.groupBy(*keys).pivot("metric", names).agg(*pair).orderBy(*keys),
        f"{path}/summary_metrics",
    )
    write_history(result.history, f"{path}/history")
    write_log(history_lines(result.history), f"{path}/log")


def history_lines(history: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys..., line): the figures of one epoch or step as a JSON object with the keys it has."""
    figures = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    whole = history.groupBy(*keys, "epoch", "step").agg(F.to_json(figures).alias("_figures"))
    head = F.concat(F.lit('{"epoch": '), F.col("epoch"), F.coalesce(F.concat(F.lit(', "step": '), F.col("step")), F.lit("")), F.lit(", "))
    return whole.select(*keys, F.concat(head, F.substr("_figures", F.lit(2))).alias("line"))
