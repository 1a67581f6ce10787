"""The registered queries: (spark, folder of the given tables) -> DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlab.catalog import views
from threadlab.functions import text
from threadlab.functions.registry import CLASSES, COARSE_LABELS, FINE_LABELS, LABEL_MAP, Topic
from threadlab.operators import history, labels, layout, metrics, pairs, scoring, splits, threads, training
from threadlab.plans import experiments, zero_shot
from threadlab.plans.threads import process_threads
from threadlab.session import materialise, scratch_path
from threadlab.sources import files, readers, writers
from threadlab.streaming.ingest import ingest_threads, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOPIC = ["topic"]
EXPERIMENT = ["experiment_name"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums over partitions have no fixed order."""
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# ---- threads ---------------------------------------------------------------------------------


@query
def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    pattern = r"^https?://([^/?#]+)/([^/?#]+)/([^/?#]+)"
    parts = threads.resolve_links(views.table(spark, sf, "pages").select("page_id", "url"), "url", pattern)
    return parts.select(
        "page_id",
        F.col("link_subreddit").alias("host"),
        F.col("link_id").alias("part_1"),
        F.col("link_title").alias("part_2"),
    )


@query
def pending_posts(spark: SparkSession, sf: str) -> DataFrame:
    rest = threads.pending_posts(views.posts(spark, sf), views.done(spark, sf))
    return rest.select("post_id", "subreddit", "num_comments")


@query
def comment_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return threads.comment_rows(views.comments(spark, sf)).select("post_id", "id", "created_utc")


@query
def comment_rows(spark: SparkSession, sf: str) -> DataFrame:
    return threads.comment_rows(views.comments(spark, sf)).select(
        "id", "parent_id", "is_top_level",
        F.coalesce("author", F.lit(threads.UNKNOWN_AUTHOR)).alias("author"),
    )


@query
def reply_edges(spark: SparkSession, sf: str) -> DataFrame:
    return threads.reply_edges(views.comments(spark, sf))


@query
def distinct_edges(spark: SparkSession, sf: str) -> DataFrame:
    return threads.distinct_edges(views.comments(spark, sf))


@query
def reply_network_stats(spark: SparkSession, sf: str) -> DataFrame:
    return threads.reply_network_stats(threads.reply_edges(views.comments(spark, sf)))


@query
def network_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Node positions after four rounds: as many as the SQL spells out."""
    return _rounded(layout.network_layout(threads.reply_edges(views.comments(spark, sf)), 4))


@query
def upsert_post_stats(spark: SparkSession, sf: str) -> DataFrame:
    pending = threads.pending_posts(views.posts(spark, sf), views.done(spark, sf))
    raw = threads.comments_of(views.comments(spark, sf), pending)
    stats = threads.reply_network_stats(threads.reply_edges(raw))
    updated = threads.upsert_post_stats(views.posts(spark, sf), stats)
    return updated.select("post_id", "subreddit", "nodes", "edges", "time")


@query
def comment_depth(spark: SparkSession, sf: str) -> DataFrame:
    return threads.comment_depth(views.comments(spark, sf))


@query
def bfs_order(spark: SparkSession, sf: str) -> DataFrame:
    return threads.bfs_order(views.comments(spark, sf))


@query
def orphan_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comments cut off in a dump that lost every comment without an author."""
    return threads.orphan_comments(views.comments(spark, sf).filter("author IS NOT NULL"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return threads.thread_documents(views.comments(spark, sf), views.posts(spark, sf), max_comments=1_000)


@query
def thread_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A digest per thread of the nested records: sizes, and the ends of the comment order."""
    docs = _documents(spark, sf).select(
        F.col("submission.id").alias("post_id"), "part",
        F.col("submission.num_comments").alias("num_comments"),
        F.col("submission.created_utc").alias("created_utc"),
        F.size("comments").alias("nc"), F.size("reply_network").alias("ne"),
        F.try_element_at("comments.id", F.lit(1)).alias("first_id"),
        F.try_element_at("comments.id", F.lit(-1)).alias("last_id"),
    )
    return docs.groupBy("post_id", "num_comments", "created_utc").agg(
        F.sum("nc").alias("n_comments"), F.sum("ne").alias("n_edges"),
        F.min_by("first_id", "part").alias("first_id"), F.max_by("last_id", "part").alias("last_id"),
    )


@query
def flatten_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSON and read back, one row per comment."""
    path = scratch_path(spark, "threads")
    writers.write_threads(_documents(spark, sf), path)
    flat = threads.flatten_threads(readers.read_threads(spark, path))
    return flat.select("post_id", "id", "author", "body", "score", "parent_id", "depth", "created_utc")


@query
def thread_files(spark: SparkSession, sf: str) -> DataFrame:
    """Threads written to a JSON file each, then the listed ones read back."""
    path = scratch_path(spark, "files").removeprefix("file://")
    files.write_thread_files(_documents(spark, sf), path)
    flat = threads.flatten_threads(readers.read_threads(spark, f"{path}/*.json", pretty=True))
    listed = flat.join(files.read_manifest(spark, path), "post_id", "left_semi")
    return listed.select("post_id", "id", "author", "body", "score", "parent_id", "depth", "created_utc")


@query
def process_pending_threads(spark: SparkSession, sf: str) -> DataFrame:
    """The whole extraction for the threads not done yet: the post list it writes back."""
    tables = process_threads(views.posts(spark, sf), views.comments(spark, sf), views.done(spark, sf))
    return tables.posts.select("post_id", "num_comments", "nodes", "edges")


@query
def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Records landed in two lots, the second repeating the first: edges stored after both."""
    docs = materialise(_documents(spark, sf), "landing-docs")
    landing, output, state = (scratch_path(spark, n) for n in ("landing", "ingested", "state"))
    before = views.done(spark, sf).withColumnRenamed("post_id", "p")
    first = docs.join(before, docs.submission.id == before.p, "left_semi")
    for lot in (first, docs):
        writers.write_threads(lot, landing)
        ingest_threads(spark, landing, output, state)
    edges = read_table(spark, output, "edges")
    return edges.select("post_id", "source", "target", "comment_id")


# ---- gold standard and labels ----------------------------------------------------------------


@query
def scan_posts(spark: SparkSession, sf: str) -> DataFrame:
    """A post list written as CSV, then read with stated types and the null spellings."""
    pages = views.table(spark, sf, "pages")
    is_third = F.col("page_id") % 3 == 0
    rows = pages.select(
        F.col("url").alias("link"),
        F.concat(F.lit("g"), "page_id").alias("post_id"),
        F.lit("s").alias("subreddit"),
        F.concat(F.lit('a "quoted", title '), "page_id").alias("title"),
        F.when(is_third, "53000.0").otherwise(F.length("html").cast("string")).alias("upvotes"),
        F.when(is_third, "N/A").otherwise(F.col("page_id").cast("string")).alias("comments"),
        F.when(is_third, "").otherwise(F.lit("one, two")).alias("cites"),
        F.when(is_third, "nan").otherwise(F.lit("kept ")).alias("notes"),
        F.lit(None).cast("string").alias("nodes"),
        F.lit("7").alias("edges"),
        (F.col("page_id") / 7.0).alias("time"),
    )
    path = scratch_path(spark, "posts")
    writers.write_posts(rows, path)
    return readers.read_posts(spark, {"web": path})


@query
def scan_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold rows written as CSV, line breaks included, and read back."""
    path = scratch_path(spark, "gold")
    writers.write_csv(views.gold_dirty(spark, sf).withColumnRenamed("label", "assigned_label"), path)
    rows = readers.read_gold(spark, path)
    return rows.select("id", F.md5("comment").alias("comment_md5"), "topic", "label")


@query
def filled_posts(spark: SparkSession, sf: str) -> DataFrame:
    """A post list with gaps, written and read back, its gaps filled from the links."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    page = F.col("page_id")
    nothing = F.lit(None).cast("string")
    rows = views.table(spark, sf, "pages").select(
        F.col("url").alias("link"),
        F.when(page % 2 == 0, nothing).otherwise(F.concat(F.lit("g"), "page_id")).alias("post_id"),
        F.when(page % 3 == 0, "nan").when(page % 3 == 1, host).otherwise(F.lit("elsewhere")).alias("subreddit"),
        nothing.alias("title"), nothing.alias("upvotes"), page.cast("string").alias("comments"),
        nothing.alias("cites"), nothing.alias("notes"), nothing.alias("nodes"), nothing.alias("edges"),
        F.lit(0.0).alias("time"),
    )
    path = scratch_path(spark, "posts")
    writers.write_posts(rows, path)
    filled = threads.fill_from_links(
        readers.read_posts(spark, {"web": path}), r"^https?://([^/?#]+)/([^/?#]+)/([^/?#]+)"
    )
    return filled.select(F.col("comments").alias("page_id"), "post_id", "subreddit", "title", "link_ok")


@query
def prepare_gold(spark: SparkSession, sf: str) -> DataFrame:
    ready = labels.prepare_gold(views.gold_dirty(spark, sf), topics=["de", "en", "es"])
    return ready.select("id", F.md5("comment").alias("comment_md5"), "topic", "label")


@query
def topic_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = labels.topic_filter(views.gold_dirty(spark, sf), "en")
    return rows.select("id", "topic", F.lower("label").alias("label"))


@query
def normalize_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.gold_dirty(spark, sf)
    return rows.select(
        "id", text.normalize_label("label").alias("label"), text.normalize_topic("topic").alias("topic")
    )


@query
def valid_comments(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.gold_dirty(spark, sf)
    return rows.select(
        "id",
        text.is_valid_comment("comment").alias("valid"),
        text.is_valid_comment("comment", 1).alias("valid_1"),
        text.word_count("comment").alias("words"),
    )


@query
def label_map_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The label map read from JSON, with the number of predictions each entry maps."""
    path = scratch_path(spark, "label-map")
    spark.createDataFrame([(json.dumps(LABEL_MAP, indent=4),)], "value string").write.text(path)
    used = views.predictions(spark, sf).groupBy(F.col("pred_raw").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return readers.read_label_map(spark, path).join(used, "label", "left").fillna(0, ["n"])


@query
def map_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.predictions(spark, sf).select("id", "pred_raw")
    return labels.map_labels(rows, LABEL_MAP, "pred_raw", "pred")


@query
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.expand_experiments(views.gold(spark, sf).select("id", "topic", "label"))
    classes = labels.class_index(rows, "label", EXPERIMENT)
    return labels.encode_labels(rows, classes, "label", EXPERIMENT).select(
        "experiment_name", "id", "label", "label_id"
    )


# ---- scoring ---------------------------------------------------------------------------------


def _lexicon_labelled(spark: SparkSession, sf: str, dirty: bool = False) -> DataFrame:
    rows = views.gold_dirty(spark, sf) if dirty else views.gold(spark, sf)
    scorer = scoring.lexicon_scorer(COARSE_LABELS, views.TERMS, views.PRIORS)
    return zero_shot.label_gold(rows, scorer)


@query
def zero_shot_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_lexicon_labelled(spark, sf, dirty=True).drop("comment"))


@query
def zero_shot_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics with fine candidate labels of their own; one of them has no coarse counterpart."""
    topics, scorers = [], {}
    for name, registered in views.FINE_TOPICS.items():
        names = FINE_LABELS[registered]
        terms = {x: (term,) for x, term in zip(names, views.FINE_TERMS[name])}
        topics.append(Topic(name, labels=names))
        scorers[name] = scoring.lexicon_scorer(names, terms, {names[-1]: 0.5})
    return _rounded(zero_shot.label_topics(views.gold(spark, sf), topics, scorers).drop("comment"))


@query
def zero_shot_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """How well the lexicon labels each class of each topic."""
    result = zero_shot.evaluate(_lexicon_labelled(spark, sf))
    return _rounded(result.per_class)


@query
def labelled_results(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled gold table written as CSV, line breaks included, and read back."""
    path = scratch_path(spark, "labelled")
    writers.write_labelled(_lexicon_labelled(spark, sf), path)
    back = spark.read.options(**readers.CSV, multiLine=True).csv(path).drop("comment")
    return _rounded(back.withColumns({"id": F.col("id").cast("bigint"), "pred_score": F.col("pred_score").cast("double")}))


@query
def evaluation_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The files of an evaluation read back: the class table, with the accuracy of the overall figures."""
    path = scratch_path(spark, "evaluation")
    writers.write_evaluation(zero_shot.evaluate(_lexicon_labelled(spark, sf)), path)
    table = spark.read.options(**readers.CSV).csv(f"{path}/per_class_metrics")
    numbers = {c: F.col(c).cast("double") for c in ("precision", "recall", "f1")}
    overall = spark.read.json(f"{path}/overall_metrics").select("topic", "accuracy")
    return _rounded(
        table.withColumns({**numbers, "support": F.col("support").cast("bigint")}).join(overall, "topic")
    )


LETTERS = "eao"


def _letter_model():
    """Stub model: counts a letter per label."""
    return lambda texts: [[float(t.count(c)) for c in LETTERS] for t in texts]


def _letter_pairs():
    """Stub pair model: how often the last letter of the statement stands in the comment."""
    return lambda batch: [float(comment.count(statement[-1])) for comment, statement in batch]


@query
def zero_shot_pairs(spark: SparkSession, sf: str) -> DataFrame:
    scorer = pairs.pair_scorer(_letter_pairs, pairs.hypotheses(LETTERS, "has an {}"))
    return _rounded(zero_shot.label_gold(views.gold_dirty(spark, sf), scorer).drop("comment"))


@query
def zero_shot_trained_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by a pair model that learned from the gold rows, which are joined once."""
    gold = materialise(views.gold(spark, sf), "gold")
    model = pairs.train_pairs(gold, COARSE_LABELS)
    scorer = pairs.pair_scorer(lambda: model, pairs.hypotheses(COARSE_LABELS))
    return _rounded(zero_shot.evaluate(zero_shot.label_gold(gold, scorer)).report)


@query
def zero_shot_model(spark: SparkSession, sf: str) -> DataFrame:
    scorer = scoring.model_scorer(_letter_model, len(COARSE_LABELS))
    return _rounded(zero_shot.label_gold(views.gold_dirty(spark, sf), scorer).drop("comment"))


@query
def label_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    means = scoring.label_prototypes(views.table(spark, sf, "embeddings"), 64)
    rows = means.select("label", "n", F.posexplode("prototype").alias("pos", "mean"))
    return _rounded(rows)


@query
def zero_shot_prototype(spark: SparkSession, sf: str) -> DataFrame:
    vectors = views.table(spark, sf, "embeddings")
    candidates = list(range(10))
    matrix = scoring.collect_prototypes(scoring.label_prototypes(vectors, 64), candidates)
    scored = scoring.prototype_scorer(matrix)(vectors, "embedding", "scores")
    best = F.array_max("scores")
    return _rounded(
        scored.select(
            "vec_id", "label",
            (F.array_position("scores", best) - 1).cast("int").alias("pred_label"),
            best.alias("cosine"),
        )
    )


@query
def argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.argmax_label(views.score_rows(spark, sf))


@query
def label_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.label_ranking(views.score_rows(spark, sf))


# ---- metrics ---------------------------------------------------------------------------------


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_counts(views.predictions(spark, sf), "gold", "pred", TOPIC)


@query
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.accuracy(_counts(spark, sf), TOPIC))


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_counts(spark, sf), TOPIC, "gold")


@query
def confusion_matrix_union(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_counts(spark, sf), TOPIC, "union")


@query
def confusion_matrix_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = metrics.confusion_matrix_wide(_counts(spark, sf), CLASSES, TOPIC)
    return wide.withColumnRenamed("fact-check", "fact_check")


@query
def confusion_matrix_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.confusion_matrix_normalized(_counts(spark, sf), TOPIC, "union"))


@query
def per_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.per_class_metrics(_counts(spark, sf), TOPIC, "gold"))


@query
def macro_weighted_averages(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.macro_weighted_averages(_counts(spark, sf), TOPIC, "union"))


@query
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.classification_report(_counts(spark, sf), TOPIC, "union"))


@query
def one_vs_rest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    declared = metrics.one_vs_rest_metrics(_counts(spark, sf), TOPIC, "declared", [*CLASSES, "never"])
    return _rounded(declared)


@query
def binary_cells(spark: SparkSession, sf: str) -> DataFrame:
    rates = metrics.one_vs_rest_metrics(_counts(spark, sf), TOPIC, "gold")
    return metrics.binary_cells(rates, TOPIC)


@query
def error_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty errors, with the number of all errors."""
    rows = views.predictions(spark, sf)
    total = metrics.misclassified(rows).agg(F.count(F.lit(1)).alias("n_errors"))
    first = metrics.error_analysis(rows, ["id"])
    return first.select("id", "gold", "pred", "max_logit", total.scalar().alias("n_errors"))


@query
def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["topic", "model_key"]
    rows = views.predictions(spark, sf)
    counts = metrics.confusion_counts(rows, "gold", "pred", [*keys, "fold"])
    report = metrics.classification_report(counts, [*keys, "fold"], "union")
    lines = metrics.metric_rows(report, [*keys, "fold"])
    return _rounded(metrics.fold_summary(lines, keys))


# ---- splits ----------------------------------------------------------------------------------


def _gold_keys(spark: SparkSession, sf: str) -> DataFrame:
    return views.gold(spark, sf).select("id", "topic", "label")


@query
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.expand_experiments(_gold_keys(spark, sf))
    return splits.class_counts(rows, "label", EXPERIMENT)


@query
def unstratifiable_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.expand_experiments(_gold_keys(spark, sf))
    return splits.unstratifiable_classes(rows, 5, "label", EXPERIMENT)


@query
def experiment_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "documents")
    raw = F.concat(F.lit("ul:"), "lang", F.lit("/"), "source", F.lit(" a-b\\c"))
    return rows.select(
        "doc_id", text.safe_name(raw).alias("name"), text.class_key("source").alias("class_key"),
        text.class_file_name(raw).alias("file_name"),
    )


@query
def experiment_expansion(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.expand_experiments(_gold_keys(spark, sf), topics=["de", "en", "fr"])
    return rows.select("experiment_name", "id", "label")


@query
def stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.expand_experiments(_gold_keys(spark, sf))
    return splits.stratified_kfold(rows, 5, 42, group=EXPERIMENT).select("experiment_name", "id", "label", "fold")


@query
def fold_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the train, validation and test sides of every run, per class."""
    rows = splits.stratified_runs(_gold_keys(spark, sf), 5, 0.15, 42)
    return splits.split_sizes(splits.fold_roles(rows, 5), ["run", "label"])


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_split(_gold_keys(spark, sf), 0.15, 42).select("id", "label", "role")


@query
def train_val_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.train_val_test_split(_gold_keys(spark, sf), 0.3, 0.5, 42).select("id", "label", "role")


# ---- histories, training -----------------------------------------------------------------------


@query
def early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    return history.early_stopping(views.history(spark, sf), 2)


@query
def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    return history.learning_curve(views.history(spark, sf))


@query
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.term_frequencies(views.gold(spark, sf), "comment", 256, 1024)
    weighted = training.weighted_features(rows)[0]
    size = training.vector_to_array("features")
    return weighted.select("id", "label", F.size(F.filter(size, lambda x: x > 0)).alias("active"))


@query
def text_feature_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the hashed counts of a document hold."""
    rows = training.term_frequencies(views.gold(spark, sf), "comment", 256, 1024)
    counts = training.vector_to_array("tf")
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x).cast("bigint")
    return rows.select("id", "label", total.alias("tokens"))


def _experiment() -> experiments.ExperimentConfig:
    return experiments.ExperimentConfig(topics=("en",))


def _all_experiments(gold: DataFrame) -> experiments.ExperimentConfig:
    """Pooled, and every topic that the class guard lets through."""
    return experiments.ExperimentConfig(topics=experiments.topics_with_folds(gold, experiments.ExperimentConfig()))


@query
def topic_workflow(spark: SparkSession, sf: str) -> DataFrame:
    result = experiments.run_topic(views.gold(spark, sf), "en", _experiment())
    return _rounded(result.report)


@query
def train_history(spark: SparkSession, sf: str) -> DataFrame:
    result = experiments.run_topic(views.gold(spark, sf), "en", _experiment(), "hidden")
    return _rounded(result.history)


@query
def cv_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    gold = views.gold(spark, sf)
    return _rounded(experiments.run_cv(gold, _all_experiments(gold)).fold_metrics)


@query
def workflow_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a single-topic run read back: class sizes of the test rows, and the stop of training.

    ``stops_by_rule`` is 1 if the history ends where the early-stopping rule says.
    """
    config = _experiment()
    result = experiments.run_topic(views.gold(spark, sf), "en", config)
    path = scratch_path(spark, "workflow")
    writers.write_workflow(result, spark, path)
    report = spark.read.json(f"{path}/classification_report").filter("support IS NOT NULL")
    cells = spark.read.options(**readers.CSV).csv(f"{path}/binary_confusion_matrices")
    found = cells.filter(F.col("metric").isin("True Positive", "False Negative"))
    log = spark.read.json(f"{path}/training_history/json").select("fold", "epoch", "eval_macro_f1")
    stop = history.early_stopping(log, config.train.patience, ["fold"], "epoch", "eval_macro_f1")
    last = log.agg(F.max("epoch").alias("last"))
    parts = [
        report.select(F.lit("report").alias("output"), F.col("label").alias("key"), F.col("support").cast("bigint").alias("value")),
        found.groupBy("class").agg(F.sum(F.col("value").cast("bigint"))).select(F.lit("binary_cells"), "*"),
        stop.join(last, stop.stop_epoch == last["last"]).select(
            F.lit("history"), F.lit("stops_by_rule"), F.lit(1).cast("bigint")
        ),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query
def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines of differing keys, written and read back: what lines hold what, and as which type."""
    path = scratch_path(spark, "log")
    rows = views.events(spark, sf)
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.to_json(F.struct("event_id", F.col("value").alias("loss"))))
        .when(kind == "view", F.to_json(F.struct("event_id", F.concat(F.lit('a "b" '), "user_id").alias("note"), F.col("value").alias("loss"))))
        .when(kind == "signup", F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "loss": null, "nested": '), "props", F.lit("}")))
        .when(kind == "error", F.concat(F.lit("{broken "), "event_id"))
        .otherwise(F.to_json(F.struct("event_id", kind.alias("loss"))))
    )
    writers.write_log(rows.select(kind.alias("kind"), line.alias("line")), path)
    log = readers.read_log(spark, path, {"event_id": "bigint", "loss": "double", "note": "string", "nested.k": "bigint"})
    return _rounded(log.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("line").alias("n_lines"), F.sum("event_id").alias("ids"),
        F.sum("loss").cast("decimal(38,4)").cast("double").alias("loss"), F.max("note").alias("note"),
        F.sum(F.col("`nested.k`")).alias("k"), F.count_if(F.is_variant_null(F.try_variant_get("line", "$.loss", "variant"))).alias("n_null"),
    ))


@query
def report_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a run read back: predictions and reports by run, error table, normalised matrix, stamped metrics."""
    path = scratch_path(spark, "sinks")
    rows = views.predictions(spark, sf).select(
        F.col("topic").alias("experiment_name"), "model_key", "fold", "id", F.col("gold").alias("gold_label"),
        F.col("pred").alias("predicted_label"), "max_logit",
    )
    run = writers.RUN
    writers.write_predictions(rows, f"{path}/predictions")
    counts = metrics.confusion_counts(rows, "gold_label", "predicted_label", run)
    writers.write_reports(metrics.classification_report(counts, run, "union"), f"{path}/reports")
    writers.write_csv(metrics.error_analysis(rows, ["id"], "gold_label", "predicted_label"), f"{path}/errors")
    whole = metrics.confusion_counts(rows, "gold_label", "predicted_label")
    names = [r[0] for r in whole.select(F.explode(F.array("true_label", "pred_label"))).distinct().orderBy("col").collect()]
    matrix = metrics.confusion_matrix_normalized(whole, grid="union")
    writers.write_csv(metrics.wide_matrix(matrix, names, value="share"), f"{path}/matrix")
    found = metrics.metric_rows(metrics.classification_report(whole, grid="union"), []).collect()
    writers.write_metrics({r.metric: r.value for r in found}, spark, f"{path}/metrics", "ALL ROWS", "now")

    name = F.concat_ws("/", *run)
    value = F.col("value").cast("double")
    back = spark.read.options(**readers.CSV).csv(f"{path}/predictions")
    wide = spark.read.options(**readers.CSV).csv(f"{path}/matrix")
    cells = wide.unpivot(["true_label"], names, "pred_label", "value")
    text = spark.read.text(f"{path}/metrics/text").select(F.split("value", ": ").alias("p")).where("size(p) = 2")
    parts = [
        back.groupBy(name.alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows").alias("output"), "key", "value"),
        back.groupBy(name).agg(F.sum(F.col("max_logit").cast("decimal(38,4)")).cast("double")).select(F.lit("logits"), "*"),
        spark.read.json(f"{path}/reports").select(F.lit("report"), F.concat_ws("/", name, "label"), "f1"),
        spark.read.options(**readers.CSV).csv(f"{path}/errors").select(F.lit("error"), "id", F.col("max_logit").cast("double")),
        cells.select(F.lit("matrix"), F.concat_ws("/", "true_label", "pred_label"), value),
        spark.read.json(f"{path}/metrics/json").select(F.lit("json"), "key", value),
        text.select(F.lit("text"), F.col("p")[0], F.col("p")[1].cast("double")),
    ]
    return _rounded(reduce(DataFrame.union, parts))


@query
def cv_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The files of all cross-validation runs read back: split sizes and class sizes of each run."""
    path = scratch_path(spark, "cv")
    gold = views.gold(spark, sf)
    experiments.run_experiments(gold, _all_experiments(gold), path)
    folds = spark.read.options(**readers.CSV).csv(f"{path}/run_ts=*/all_folds_metrics")
    sizes = ("n_train", "n_val", "n_test", "belief_support", "fact_check_support", "other_support")
    return folds.select(
        "experiment_name", "model_key", F.col("fold").cast("int").alias("fold"),
        *[F.col(c).cast("double").cast("bigint").alias(c) for c in sizes],
    )
