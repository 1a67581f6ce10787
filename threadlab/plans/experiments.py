"""Cross-validated experiments and the single-topic train/validate/test workflow."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlab.functions.registry import DEFAULT_TOPICS
from threadlab.operators import metrics, minibatch, splits
from threadlab.operators.labels import (
    class_index,
    encode_labels,
    missing_topics,
    prepare_gold,
    topic_filter,
)
from threadlab.operators.training import (
    DEFAULT_MODELS,
    MODELS,
    NETWORKS,
    TrainConfig,
    Trained,
    evaluate,
    observed_write,
    predict,
    term_frequencies,
    timed_write,
    weighted_features,
)
from threadlab.session import materialise
from threadlab.sources import writers

HISTORY = "experiment_name string, model_key string, fold int, epoch int, step int, key string, value double"
KEYS = ["experiment_name", "model_key", "model_name"]


@dataclass(frozen=True)
class ExperimentConfig:
    text: str = "comment"
    topic: str = "topic"
    label: str = "label"
    id_col: str = "id"
    topics: Sequence[str] = DEFAULT_TOPICS
    run_pooled: bool = True
    run_per_topic: bool = True
    models: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_MODELS))
    n_splits: int = 5
    seed: int = 42
    val_size: float = 0.15
    parallelism: int = 6
    train: TrainConfig = field(default_factory=TrainConfig)

    def check(self) -> None:
        if not self.run_pooled and not self.run_per_topic:
            raise ValueError("set run_pooled, run_per_topic or both")
        known = {**NETWORKS, **MODELS}
        unknown = [m for m in self.models if m not in known]
        if unknown:
            raise ValueError(f"unknown models {unknown}; known: {sorted(known)}")
        if self.n_splits > 62:
            raise ValueError("at most 62 folds")


@dataclass
class CVResult:
    predictions: DataFrame
    fold_metrics: DataFrame
    report: DataFrame
    summary: DataFrame
    history: DataFrame
    totals: dict[str, float]  # rows, errors and seconds inside models, counted by the writes of predictions


def run_config(
    spark: SparkSession, cfg: ExperimentConfig, data_path: str | None = None, output_path: str | None = None
) -> DataFrame:
    """The parameters of a run as one row, nested settings flattened, and where its rows come from and go."""
    flat = {k: v for k, v in asdict(cfg).items() if k != "train"}
    flat.update(asdict(cfg.train))
    flat["topics"] = list(cfg.topics)
    flat["models"] = dict(cfg.models)
    row = spark.createDataFrame([flat])
    return row.withColumns({"data_path": F.lit(data_path).cast("string"), "output_path": F.lit(output_path).cast("string")})


Named = tuple[Trained | minibatch.Fitted, str, str, int]  # experiment, model and fold


def _history(spark: SparkSession, found: Sequence[Named]) -> DataFrame:
    """Long lines; figures of a step carry its number, those of an epoch none. The steps of an epoch
    leave the driver as one row of arrays."""
    lines = [
        (*key, line["epoch"], None, k, float(v))
        for trained, *key in found
        for line in (trained.epochs if isinstance(trained, minibatch.Fitted) else trained.history)
        for k, v in line.items()
        if k != "epoch" and v is not None
    ]
    steps = [
        (*key, line["epoch"], own[:, 0].astype(int).tolist(), (own[:, 1] / own[:, 2]).tolist(), own[:, 3].tolist())
        for trained, *key in found
        if isinstance(trained, minibatch.Fitted)
        for line, own in zip(trained.epochs, trained.steps, strict=True)
    ]
    whole = spark.createDataFrame(lines, HISTORY)
    if not steps:
        return whole
    arrays = spark.createDataFrame(
        steps, "experiment_name string, model_key string, fold int, epoch int, step array<int>, step_loss array<double>, learning_rate array<double>"
    )
    keys = ["experiment_name", "model_key", "fold", "epoch"]
    single = arrays.select(*keys, F.inline(F.arrays_zip("step", "step_loss", "learning_rate")))
    figures = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("step_loss", "learning_rate")])
    return whole.unionByName(single.select(*keys, "step", F.inline(figures)))


def _counted(rows: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Hashed words, as each kind of model wants them."""
    train = cfg.train
    out = rows.withColumn("slots", minibatch.hashed_words(cfg.text, train.max_length, train.n_features))
    if any(m in MODELS for m in cfg.models):
        out = term_frequencies(out, cfg.text, train.max_length, train.n_features)
    return out


def topics_with_folds(gold: DataFrame, cfg: ExperimentConfig) -> list[str]:
    """Topics of which every class has a row for each fold, in order of name."""
    rows = prepare_gold(gold, cfg.text, cfg.topic, cfg.label)
    counts = rows.groupBy(cfg.topic, cfg.label).count().groupBy(cfg.topic).agg(F.min("count").alias("least"))
    return [r[0] for r in counts.filter(F.col("least") >= cfg.n_splits).orderBy(cfg.topic).collect()]


def prepare_folds(gold: DataFrame, cfg: ExperimentConfig) -> tuple[DataFrame, DataFrame]:
    """Written table of every row's hashed words, label id, experiment, fold and validation runs.

    Text is turned into hashed words once, and written.  Folds and the validation rows of all runs
    come from one ranking, so that each run later selects its rows by a filter, without a shuffle.
    The second table has the split sizes per experiment and run.
    """
    cfg.check()
    clean = materialise(_counted(prepare_gold(gold, cfg.text, cfg.topic, cfg.label), cfg), "counted")
    if cfg.run_per_topic:
        for topic in missing_topics(clean, cfg.topics, cfg.topic):
            warnings.warn(f"no rows for topic {topic!r}", stacklevel=3)
    rows = splits.expand_experiments(
        clean, cfg.topic, cfg.run_pooled, cfg.run_per_topic, cfg.topics
    )
    group = ["experiment_name"]
    splits.require_min_class_count(rows, cfg.n_splits, cfg.label, group)
    coded = encode_labels(rows, class_index(rows, cfg.label, group), cfg.label, group)
    drawn = splits.stratified_runs(
        coded, cfg.n_splits, cfg.val_size, cfg.seed, cfg.label, cfg.id_col, group
    )
    data = materialise(drawn, "folds", ["experiment_name", "fold"])
    keys = data.select("experiment_name", "fold", "val_runs")
    return data, splits.split_sizes(splits.fold_roles(keys, cfg.n_splits), [*group, "run"])


def run_cv(gold: DataFrame, cfg: ExperimentConfig) -> CVResult:
    """All experiments x models x folds: one training for all networks, the other models fitted one by
    one; metrics of all of them in one grouped job at the end."""
    spark = gold.sparkSession
    data, sizes = prepare_folds(gold, cfg)
    class_rows = data.select("experiment_name", cfg.label, "label_id").distinct().collect()
    classes: dict[str, list[str]] = {}
    for name in sorted({r["experiment_name"] for r in class_rows}):
        own = sorted((r["label_id"], r[cfg.label]) for r in class_rows if r["experiment_name"] == name)
        classes[name] = [label for _, label in own]

    networks, others = _run_networks(data, classes, cfg), _run_others(data, classes, cfg)
    written = [x for x in (networks, others) if x]
    predictions = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [w.predictions for w in written])
    group = [*KEYS, "fold"]
    counts = metrics.confusion_counts(predictions, "gold_label", "predicted_label", group)
    report = metrics.classification_report(counts, group, "union")
    timings = predictions.groupBy(*group).agg(F.avg("inference_time_sec").alias("value")).select(
        *group, F.lit("avg_inference_time_sec").alias("metric"), "value"
    )
    # All models of an experiment share its splits.
    names = ("n_train", "n_val", "n_test")
    size_cells = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    )
    size_rows = counts.select(*group).distinct().join(
        sizes.withColumnRenamed("run", "fold"), ["experiment_name", "fold"]
    ).select(*group, F.inline(size_cells))
    scores = metrics.metric_rows(report, group)
    fold_metrics = materialise(
        timings.unionByName(size_rows).unionByName(scores), "fold-metrics"
    )
    history = _history(spark, [x for w in written for x in w.history])
    totals = {k: sum(w.totals[k] or 0 for w in written) for k in ("rows", "errors", "seconds")}
    return CVResult(predictions, fold_metrics, report, metrics.fold_summary(fold_metrics), history, totals)


@dataclass
class _Written:
    predictions: DataFrame
    history: list[Named]
    totals: dict[str, float]


def _named(predictions: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in cfg.models.items() for x in pair])
    return predictions.withColumn("model_name", names[F.col("model_key")]).drop("val_runs", "tf")


def _run_networks(data: DataFrame, classes: dict[str, list[str]], cfg: ExperimentConfig) -> _Written | None:
    """All folds of all experiments for all models trained by epoch, in the same scans."""
    runs = [
        minibatch.Run(e, m, f, (cfg.train.n_features, *NETWORKS[m], len(names)), cfg.seed + f)
        for e, names in classes.items() for m in cfg.models if m in NETWORKS for f in range(1, cfg.n_splits + 1)
    ]
    if not runs:
        return None
    rows = data.withColumn("val_mask", minibatch.fold_mask("val_runs"))
    fitted = minibatch.train(rows, runs, classes, cfg.train, cfg.id_col, cfg.seed)
    scored = _named(minibatch.predict(data, fitted, classes, cfg.label, cfg.train.eval_batch_size), cfg)
    done, totals = observed_write(scored, lambda df: materialise(df, "predictions"))
    history = [(f, f.run.experiment, f.run.model_key, f.run.fold) for f in fitted]
    return _Written(done, history, totals)


def _run_others(data: DataFrame, classes: dict[str, list[str]], cfg: ExperimentConfig) -> _Written | None:
    """Models that Spark ML fits, one run after another on a few threads."""
    models = [m for m in cfg.models if m in MODELS]
    if not models:
        return None
    spark = data.sparkSession

    def fit(experiment: str, model_key: str, fold: int, train_x, val_x, test_x) -> tuple[DataFrame, Named]:
        names = classes[experiment]
        trained = MODELS[model_key](train_x, val_x, names, cfg.train, cfg.seed + fold)
        tagged = predict(trained.model, test_x, names, cfg.label).withColumns({
            "fold": F.lit(fold), "model_key": F.lit(model_key), "experiment_name": F.lit(experiment),
        })
        done, per_row = timed_write(_named(tagged, cfg), lambda df: materialise(df, "predictions"))
        timed = done.withColumn("inference_time_sec", F.lit(per_row).cast("double"))
        return timed, (trained, experiment, model_key, fold)

    def run_fold(experiment: str, fold: int) -> list[tuple[DataFrame, Named]]:
        """All models of one run: they share its weighted features."""
        rows = data.filter(F.col("experiment_name") == experiment).drop("slots")
        test = rows.filter(F.col("fold") == fold)
        rest, is_val = rows.filter(F.col("fold") != fold), F.array_contains("val_runs", fold)
        train_x, val_x, test_x = weighted_features(rest.filter(~is_val), rest.filter(is_val), test)
        train_x, val_x = train_x.persist(), val_x.persist()
        try:
            return [fit(experiment, m, fold, train_x, val_x, test_x) for m in models]
        finally:
            train_x.unpersist()
            val_x.unpersist()

    jobs = [(e, f) for e in classes for f in range(1, cfg.n_splits + 1)]
    with ThreadPoolExecutor(cfg.parallelism) as pool:
        # Wrapped one by one: a wrapped function hands its one copy of the local properties to every thread.
        running = [pool.submit(inheritable_thread_target(spark)(run_fold), *job) for job in jobs]
        results = [result for run in running for result in run.result()]
    predictions = reduce(DataFrame.unionByName, [r[0] for r in results])
    wrong = F.col("gold_label").isNotNull() & ~F.col("gold_label").eqNullSafe(F.col("predicted_label"))
    totals = predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("errors"), F.sum("inference_time_sec").alias("seconds")
    ).first().asDict()
    return _Written(predictions, [r[1] for r in results], totals)


def run_experiments(gold: DataFrame, cfg: ExperimentConfig, path: str, data_path: str | None = None) -> CVResult:
    """``run_cv`` with everything written below ``path``: parameters first, then the results.
    ``data_path`` says where ``gold`` was read from."""
    cfg.check()
    spark = gold.sparkSession
    stamp = writers.run_stamp(spark)
    writers.write_json(run_config(spark, cfg, data_path, path), f"{path}/run_config/run_ts={stamp}")
    result = run_cv(gold, cfg)
    writers.write_cv(result, f"{path}/run_ts={stamp}")
    return result


@dataclass
class WorkflowResult:
    classes: list[str]
    history: DataFrame
    validation: dict[str, float]
    test: dict[str, float]
    predictions: DataFrame
    report: DataFrame
    matrix: DataFrame
    one_vs_rest: DataFrame
    errors: DataFrame
    n_errors: int


def run_topic(
    gold: DataFrame, topic: str, cfg: ExperimentConfig, model_key: str = "softmax"
) -> WorkflowResult:
    """One topic: 70/15/15 split, one model, validation and test metrics, matrices, error table."""
    spark = gold.sparkSession
    rows = topic_filter(gold, topic, cfg.topic).dropna(subset=[cfg.text, cfg.label])
    cfg = replace(cfg, models={model_key: cfg.models.get(model_key, model_key)})
    cfg.check()
    counted = materialise(_counted(rows, cfg), "counted")
    coded = encode_labels(counted, class_index(counted, cfg.label), cfg.label)
    drawn = materialise(
        splits.train_val_test_split(coded, 0.3, 0.5, cfg.seed, cfg.label, cfg.id_col), "split"
    )
    found = drawn.select(cfg.label, "label_id").distinct().orderBy("label_id").collect()
    names = [r[cfg.label] for r in found]
    if model_key in NETWORKS:
        run = minibatch.Run(topic, model_key, 1, (cfg.train.n_features, *NETWORKS[model_key], len(names)), cfg.seed)
        tagged = drawn.withColumns({
            "experiment_name": F.lit(topic),
            "fold": F.when(F.col("role") == "test", 1).otherwise(0),
            "val_mask": F.when(F.col("role") == "val", 2).otherwise(0).cast("long"),
        })
        (trained,) = minibatch.train(tagged, [run], {topic: names}, cfg.train, cfg.id_col, cfg.seed)
        scored = minibatch.predict(
            tagged.filter("fold = 1"), [trained], {topic: names}, cfg.label, cfg.train.eval_batch_size
        ).drop("experiment_name", "fold", "val_mask", "model_key")
        predictions, totals = observed_write(scored, lambda df: materialise(df, "predictions"))
    else:
        parts = (drawn.filter(F.col("role") == r).drop("slots") for r in ("train", "val", "test"))
        train_x, val_x, test_x = weighted_features(*parts)
        train_x, val_x = train_x.persist(), val_x.persist()
        try:
            trained = MODELS[model_key](train_x, val_x, names, cfg.train, cfg.seed)
            scored = predict(trained.model, test_x, names, cfg.label)
            predictions, totals = observed_write(scored, lambda df: materialise(df, "predictions"), None)
        finally:
            train_x.unpersist()
            val_x.unpersist()
    counts = metrics.confusion_counts(predictions, "gold_label", "predicted_label")
    errors = metrics.error_analysis(predictions, [cfg.id_col], "gold_label", "predicted_label").select(
        cfg.id_col,
        F.col(cfg.text).alias("text"),
        F.col("gold_label").alias("true_label"),
        "predicted_label",
        "max_logit",
        "max_prob",
    )
    declared = {"grid": "declared", "classes": names}
    return WorkflowResult(
        classes=names,
        history=_history(spark, [(trained, f"topic_{topic}", model_key, 0)]),
        validation=trained.validation(),
        test=evaluate(predictions, names),
        predictions=predictions,
        report=metrics.classification_report(counts, **declared),
        matrix=metrics.confusion_matrix_normalized(counts, **declared),
        one_vs_rest=metrics.one_vs_rest_metrics(counts, **declared),
        errors=errors,
        n_errors=totals["errors"],
    )
