"""Text classifiers trained together by mini-batches, all runs in one scan.

A run is one (experiment, fold, model). All runs read one table of hashed words; a row serves a run
as training, validation or test row by its fold. The steps of a run follow one another, those of
different runs do not: an epoch is dealt into portions of ``PORTION`` training rows a run at most, and
in one job a portion the models of each (experiment, fold) move through their batches in a task of
their own (AdamW, falling rate). Weights and moments go from portion to portion in a written table; the
driver sees weights and losses once an epoch. Batches larger than a portion are the other way round:
a step is a job, tasks add up the gradients of all runs, and the driver moves the weights.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.functions.text import first_words
from threadlab.operators.history import should_stop
from threadlab.session import discard, materialise

PORTION = 1 << 17  # training rows of a run that one task goes through in a job, at most
DENSE = 2048  # columns up to which the word counts of a block of rows are a matrix
TREE = 16  # parts whose sums the driver adds up itself
PART_ROWS = 200_000  # rows of the training table a task holds, about
COLUMNS = ["experiment_name", "fold", "val_mask", "label_id", "slots"]
SUM_ROWS = "part int, run int, sums binary"
STATES = "experiment_name string, run_fold int, run int, done int, weights binary, moments binary, steps binary"


@dataclass(frozen=True)
class Run:
    experiment: str
    model_key: str
    fold: int
    layers: tuple[int, ...]  # features, hidden units, classes
    seed: int


def hashed_words(text: str, max_length: int, n_features: int) -> Column:
    """Column numbers of the first ``max_length`` words; repeats stay."""
    slot = F.transform(first_words(text, max_length), lambda w: F.pmod(F.xxhash64(w), F.lit(n_features)).cast("int"))
    return F.coalesce(slot, F.array().cast("array<int>"))


def fold_mask(folds: str) -> Column:
    """An array of fold numbers below 63 as bits of a long."""
    return F.aggregate(folds, F.lit(0).cast("long"), lambda a, f: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), f)))


# ---- one run


def initial(run: Run) -> np.ndarray:
    """Weights of a run in one vector, layer by layer: matrix, then bias. The last layer starts at zero
    if it is the only one."""
    rng, parts = np.random.default_rng(run.seed), []
    for a, b in zip(run.layers, run.layers[1:], strict=False):
        edge = np.sqrt(6 / (a + b)) if len(run.layers) > 2 else 0.0
        parts += [rng.uniform(-edge, edge, a * b), np.zeros(b)]
    return np.concatenate(parts)


def _layers(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def logits(weights: np.ndarray, layers: Sequence[int], counts: np.ndarray, idf: np.ndarray) -> list[np.ndarray]:
    """Output of each layer for word counts weighted by ``idf``; the last one are the logits."""
    made: list[np.ndarray] = []
    for k, (w, b) in enumerate(_layers(weights, layers)):
        z = (counts @ (idf[:, None] * w) if k == 0 else made[-1] @ w) + b
        made.append(z if k == len(layers) - 2 else np.tanh(z))
    return made


def probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(
    weights: np.ndarray, layers: Sequence[int], counts: np.ndarray, idf: np.ndarray, labels: np.ndarray
) -> tuple[float, np.ndarray]:
    """Sum of the cross entropy over the rows, and its gradient."""
    made, parts = logits(weights, layers, counts, idf), _layers(weights, layers)
    p = probabilities(made[-1])
    at = np.arange(len(labels))
    loss = -np.log(np.maximum(p[at, labels], 1e-300)).sum()
    error = p
    error[at, labels] -= 1
    out: list[np.ndarray] = []
    for k in range(len(parts) - 1, -1, -1):
        below = counts if k == 0 else made[k - 1]
        gradient = below.T @ error
        out = [(gradient * idf[:, None] if k == 0 else gradient).ravel(), error.sum(axis=0), *out]
        if k:
            error = (error @ parts[k][0].T) * (1 - made[k - 1] ** 2)
    return float(loss), np.concatenate(out)


@dataclass
class Adam:
    """Adam with decoupled weight decay and a rate that falls to zero over ``steps``."""

    weights: np.ndarray
    rate: float
    decay: float
    steps: int
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    done: int = 0
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.first, self.second = np.zeros_like(self.weights), np.zeros_like(self.weights)

    def now(self) -> float:
        return self.rate * max(0.0, 1 - self.done / self.steps)

    def step(self, gradient: np.ndarray) -> float:
        """Moves the weights; returns the rate of the step."""
        rate, (a, b) = self.now(), self.betas
        self.done += 1
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient**2
        moved = (self.first / (1 - a**self.done)) / (np.sqrt(self.second / (1 - b**self.done)) + self.epsilon)
        self.weights = self.weights * (1 - rate * self.decay) - rate * moved
        return rate


# ---- sums over the table


def _cells(slots: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row (its place in ``rows``) and column of each word of the chosen rows."""
    offsets, flat = slots.offsets.to_numpy(), slots.values.to_numpy(zero_copy_only=False)
    start, size = offsets[rows].astype(np.int64), (offsets[rows + 1] - offsets[rows]).astype(np.int64)
    place = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return np.repeat(np.arange(len(rows)), size), flat[place].astype(np.int64)


def word_counts(slots: pa.ListArray, rows: np.ndarray, n_features: int) -> np.ndarray:
    """Dense counts of the chosen rows."""
    row, column = _cells(slots, rows)
    return np.bincount(row * n_features + column, minlength=len(rows) * n_features).reshape(len(rows), n_features).astype(np.float64)


class WordRows:
    """The words of some rows, as a factor in place of the matrix of their counts."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.column, self.shape = row, column, shape

    @property
    def T(self) -> WordRows:
        return WordRows(self.column, self.row, self.shape[::-1])

    def __matmul__(self, other: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, c[self.column], self.shape[0]) for c in np.ascontiguousarray(other.T)], axis=1)

    def __getitem__(self, rows: np.ndarray) -> WordRows:
        """The rows of which the mask holds."""
        kept = rows[self.row]
        return WordRows((np.cumsum(rows) - 1)[self.row[kept]], self.column[kept], (int(rows.sum()), self.shape[1]))

    def rows_with(self) -> np.ndarray:
        """Per column, the rows that have it."""
        return np.bincount(np.unique(self.row * self.shape[1] + self.column) % self.shape[1], minlength=self.shape[1])


def words_of(slots: pa.ListArray, rows: np.ndarray, n_features: int) -> np.ndarray | WordRows:
    """What stands for the word counts of the chosen rows in a product: the matrix, or the words if it is wide."""
    if n_features <= DENSE:
        return word_counts(slots, rows, n_features)
    row, column = _cells(slots, rows)
    return WordRows(row, column, (len(rows), n_features))


def _rows_at_once(block: int, n_features: int) -> int:
    """``block`` rows, or as many as dense counts of some 64 MB hold."""
    if n_features > DENSE:
        return block
    return max(1, min(block, (1 << 23) // n_features))


def _blocks(batch: pa.RecordBatch, block: int) -> Iterator[tuple[str, np.ndarray, pa.RecordBatch]]:
    """(experiment, row numbers, batch), some rows of one experiment at a time."""
    codes = batch.column(0).dictionary_encode()
    index = codes.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(codes.dictionary.to_pylist()):
        rows = np.flatnonzero(index == k)
        for i in range(0, len(rows), block):
            yield name, rows[i:i + block], batch


Chosen = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def train_rows(fold: np.ndarray, val_mask: np.ndarray, run: int) -> np.ndarray:
    return (fold != run) & ((val_mask >> run) & 1 == 0)


def val_rows(fold: np.ndarray, val_mask: np.ndarray, run: int) -> np.ndarray:
    return (fold != run) & ((val_mask >> run) & 1 == 1)


def summed(
    rows: DataFrame, runs: Sequence[Run], chosen: Chosen, of: Callable[..., np.ndarray], block: int, parts: int
) -> dict[int, np.ndarray]:
    """``of(run number, counts, labels)`` summed over the rows that ``chosen`` gives a run.

    A task sends one vector per run it has rows of. Beyond ``TREE`` tasks vectors are first added in
    groups of about the square root of their number.
    """
    by_experiment: dict[str, list[tuple[int, Run]]] = {}
    for i, run in enumerate(runs):
        by_experiment.setdefault(run.experiment, []).append((i, run))

    at_once = _rows_at_once(block, max(r.layers[0] for r in runs))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, at, own in _blocks(batch, at_once):
                fold, mask, label = (own.column(c).to_numpy(zero_copy_only=False)[at] for c in (1, 2, 3))
                wanted = by_experiment.get(name, [])
                counts = words_of(own.column(4), at, wanted[0][1].layers[0]) if wanted else None
                picked: dict[int, tuple] = {}
                for i, run in wanted:
                    if run.fold not in picked:
                        mine = chosen(fold, mask, run.fold)
                        picked[run.fold] = (counts[mine], label[mine])
                    if len(picked[run.fold][1]):
                        made = of(i, *picked[run.fold])
                        total[i] = total[i] + made if i in total else made
        if total:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(total), pa.int32()), pa.array(list(total), pa.int32()),
                pa.array([v.tobytes() for v in total.values()], pa.binary()),
            ], names=["part", "run", "sums"])

    def together(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in frame["sums"]], axis=0)
        return pd.DataFrame({"part": [0], "run": [key[0]], "sums": [total.tobytes()]})

    found = rows.select(*COLUMNS).mapInArrow(add, SUM_ROWS)
    if parts > TREE:
        found = found.groupBy("run", F.pmod("part", F.lit(int(np.sqrt(parts))))).applyInPandas(together, SUM_ROWS)
        found = found.groupBy("run").applyInPandas(together, SUM_ROWS)
    out: dict[int, np.ndarray] = {}
    for row in found.collect():  # one vector per run and part, TREE parts at most
        value = np.frombuffer(bytes(row.sums))
        out[row.run] = out[row.run] + value if row.run in out else value
    return out


# ---- figures of a run from its confusion counts


def scores_of(matrix: np.ndarray, classes: Sequence[str]) -> dict[str, float]:
    """Headline and per-class metrics of counts [true, predicted]; averages run over the classes that
    occur on either side."""
    hit, support, predicted = np.diag(matrix), matrix.sum(axis=1), matrix.sum(axis=0)
    precision, recall = (np.divide(hit, x, out=np.zeros(len(hit)), where=x > 0) for x in (predicted, support))
    both = precision + recall
    f1 = np.divide(2 * precision * recall, both, out=np.zeros(len(hit)), where=both > 0)
    total, seen = support.sum(), (support + predicted) > 0
    out: dict[str, float] = {}
    for i, c in enumerate(classes):
        key = c.replace("-", "_").replace(" ", "_")
        out |= {f"{key}_precision": precision[i], f"{key}_recall": recall[i], f"{key}_f1": f1[i], f"{key}_support": support[i]}
    for name, value in (("precision", precision), ("recall", recall), ("f1", f1)):
        out[f"macro_{name}"] = value[seen].mean() if seen.any() else 0.0
    out["weighted_f1"] = (f1 * support).sum() / total if total else 0.0
    out["accuracy"] = hit.sum() / total if total else 0.0
    return {k: float(v) for k, v in out.items()}


# ---- training


@dataclass
class Fitted:
    """Best weights of a run, its idf weights, a line for each epoch, the steps of each epoch (rows of
    number, sum of the loss, training rows, rate) and the epoch the weights are from."""

    run: Run
    weights: np.ndarray
    idf: np.ndarray
    epochs: list[dict] = field(default_factory=list)
    steps: list[np.ndarray] = field(default_factory=list)
    best_epoch: int = 0

    @property
    def history(self) -> list[dict]:
        """Lines of steps and epochs, in their order."""
        lines: list[dict] = []
        for line, steps in zip(self.epochs, self.steps, strict=True):
            lines += [
                {"epoch": line["epoch"], "step": int(k), "step_loss": loss / n, "learning_rate": rate}
                for k, loss, n, rate in steps.tolist()
            ]
            lines.append(line)
        return lines

    def validation(self) -> dict[str, float]:
        line = next(h for h in self.epochs if h["epoch"] == self.best_epoch)
        return {k.removeprefix("eval_"): v for k, v in line.items() if k.startswith("eval_")}


def document_weights(rows: DataFrame, runs: Sequence[Run], block: int, parts: int) -> tuple[dict, dict]:
    """Per (experiment, fold): idf weights, and the number of training rows."""
    folds = {(r.experiment, r.fold): r for r in runs}
    plain = list(folds.values())

    def seen(_: int, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
        found = counts.rows_with() if isinstance(counts, WordRows) else (counts > 0).sum(axis=0)
        return np.concatenate([[len(labels)], found]).astype(np.float64)

    found = summed(rows, plain, train_rows, seen, block, parts)
    empty = {i: np.zeros(1 + r.layers[0]) for i, r in enumerate(plain)}
    total = {key: (empty | found)[i] for i, key in enumerate(folds)}
    return {k: np.log((v[0] + 1) / (v[1:] + 1)) for k, v in total.items()}, {k: int(v[0]) for k, v in total.items()}


def train(rows: DataFrame, runs: Sequence[Run], classes: dict[str, list[str]], cfg, id_col: str, seed: int) -> list[Fitted]:
    """All ``runs`` on ``rows`` (``COLUMNS`` and ``id_col``), each until its early stop.

    An epoch deals the rows of an experiment to batches by a hash of their id, anew for every epoch,
    about ``batch_size`` training rows a run each. ``cfg`` is a ``TrainConfig``; the best epoch is the
    first with the highest ``best_metric`` on the validation rows.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, rows.count() // PART_ROWS + 1)
    rows = rows.select(*COLUMNS, id_col).repartition(parts, id_col).persist()
    try:
        idf, sizes = document_weights(rows, runs, cfg.eval_batch_size, parts)
        most = {e: max(n for (x, _), n in sizes.items() if x == e) for e, _ in sizes}
        batches = {e: max(1, -(-n // cfg.batch_size)) for e, n in most.items()}
        fitted = [Fitted(r, initial(r), idf[r.experiment, r.fold]) for r in runs]
        moving = [Adam(f.weights, cfg.learning_rate, cfg.weight_decay, cfg.epochs * batches[f.run.experiment]) for f in fitted]
        way = _steps_as_jobs if cfg.batch_size > PORTION else _steps_in_tasks(rows.sparkSession)
        live = list(range(len(runs)))
        number = F.create_map(*[F.lit(x) for e, n in batches.items() for x in (e, n)])[F.col("experiment_name")]
        for epoch in range(1, cfg.epochs + 1):
            batch = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(id_col)), number).cast("int")
            taken = way(rows.withColumn("batch", batch), runs, live, moving, idf, batches, cfg, parts)
            found = _pass(rows, runs, live, moving, idf, _confusion, val_rows, cfg.eval_batch_size, parts)
            for k, i in enumerate(list(live)):
                size = runs[i].layers[-1]
                matrix = found[k].reshape(size, size) if k in found else np.zeros((size, size))
                scores = scores_of(matrix, classes[runs[i].experiment])
                lost, n = taken[i][:, 1:3].sum(axis=0)
                fitted[i].steps.append(taken[i])
                fitted[i].epochs.append({"epoch": epoch, "loss": lost / max(n, 1), **{f"eval_{key}": v for key, v in scores.items()}})
                watched = [h[f"eval_{cfg.best_metric}"] for h in fitted[i].epochs]
                if epoch == 1 or watched[-1] > max(watched[:-1]):
                    fitted[i].weights, fitted[i].best_epoch = moving[i].weights.copy(), epoch
                if should_stop(watched, cfg.patience):
                    live.remove(i)
            if not live:
                break
        return fitted
    finally:
        rows.unpersist()


def _steps_as_jobs(rows, runs, live, moving, idf, batches, cfg, parts) -> dict[int, np.ndarray]:
    """An epoch of large batches: (number, loss, rows, rate) of each step by run."""
    taken: dict[int, list] = {i: [] for i in live}
    for step in range(max(batches[runs[i].experiment] for i in live)):
        now = [i for i in live if step < batches[runs[i].experiment]]
        found = _pass(rows.where(F.col("batch") == step), runs, now, moving, idf, _gradients, train_rows, cfg.eval_batch_size, parts)
        for k, i in enumerate(now):
            if k in found:
                n, loss = found[k][0], found[k][1]
                taken[i].append((step + 1, loss, n, moving[i].step(found[k][2:] / n)))
    return {i: np.array(v).reshape(-1, 4) for i, v in taken.items()}


def _steps_in_tasks(spark) -> Callable[..., dict[int, np.ndarray]]:
    """As ``_steps_as_jobs``, with the steps taken by tasks: weights come to the driver once an epoch, for
    the ``weights`` of ``moving``, moments stay in a table."""
    last: DataFrame | None = None

    def epoch(rows, runs, live, moving, idf, batches, cfg, parts) -> dict[int, np.ndarray]:
        nonlocal last
        keys = [(i, runs[i]) for i in live]
        if last is None:
            first = [(r.experiment, r.fold, i, 0, moving[i].weights.tobytes(), None, b"") for i, r in keys]
            states = spark.createDataFrame(first, STATES)
        else:
            states = last.where(F.col("run").isin(live)).withColumn("steps", F.lit(b""))
        folds: dict[str, set[int]] = {}
        for _, r in keys:
            folds.setdefault(r.experiment, set()).add(r.fold)
        wanted = F.create_map(*[x for e, v in folds.items() for x in (F.lit(e), F.array(*map(F.lit, sorted(v))))])[F.col("experiment_name")]
        serves = F.filter(wanted, lambda f: (f != F.col("fold")) & (F.call_function("getbit", F.col("val_mask"), f) == 0))
        narrow = max(r.layers[0] for _, r in keys) <= 1 << 15
        steps = max(1, PORTION // cfg.batch_size)
        portions = -(-max(batches[e] for e in folds) // steps)
        dealt = rows.select(
            "experiment_name", serves.alias("serves"), "batch", F.expr(f"batch div {steps}").cast("int").alias("portion"), "label_id",
            F.col("slots").cast("array<smallint>" if narrow else "array<int>").alias("slots"),
        ).where("size(serves) > 0")
        if portions > 1:
            dealt = materialise(dealt.repartition("experiment_name", "portion"), "dealt", ["portion"])
        context = spark.sparkContext
        settings = {i: (r.layers, idf[r.experiment, r.fold], moving[i].steps) for i, r in keys}
        shared = context.broadcast(settings)
        task = _task(shared, cfg)
        for portion in range(portions):
            own = dealt.where(F.col("portion") == portion).select("experiment_name", F.explode("serves").alias("run_fold"), "batch", "label_id", "slots")
            by = ["experiment_name", "run_fold"]
            moved = materialise(own.groupBy(*by).cogroup(states.groupBy(*by)).applyInArrow(task, STATES), "states")
            if portion or last is not None:
                discard(last)
            states = last = moved
        shared.unpersist()
        discard(dealt)
        taken = {}
        for row in last.select("run", "done", "weights", "steps").collect():  # one row a run
            moving[row.run].weights, moving[row.run].done = np.frombuffer(bytes(row.weights)).copy(), row.done
            taken[row.run] = np.frombuffer(bytes(row.steps)).reshape(-1, 4)
        return taken

    return epoch


def _task(shared, cfg) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Moves the models of one (experiment, fold) through the batches among ``examples``, in order."""

    def through(examples: pa.Table, states: pa.Table) -> pa.Table:
        models = states.to_pylist()
        for m in models:
            m["layers"], m["idf"], steps = shared.value[m["run"]]
            m["adam"] = adam = Adam(np.frombuffer(m["weights"]), cfg.learning_rate, cfg.weight_decay, steps, done=m["done"])
            if m["moments"]:
                adam.first, adam.second = np.frombuffer(m["moments"]).reshape(2, -1)
            m["taken"] = []
        if models and examples.num_rows:
            batch, label = (examples[c].to_numpy() for c in ("batch", "label_id"))
            label = label.astype(np.int64)
            slots = pa.concat_arrays(examples["slots"].chunks)
            n_features = models[0]["layers"][0]
            block = _rows_at_once(cfg.eval_batch_size, n_features)
            order = np.argsort(batch, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(batch[order])) + 1):
                sums = [0.0] * len(models)
                for i in range(0, len(at), block):
                    some = at[i:i + block]
                    counts = words_of(slots, some, n_features)
                    for k, m in enumerate(models):
                        sums[k] = sums[k] + _gradients(m["adam"].weights, m["layers"], counts, m["idf"], label[some])
                for m, found in zip(models, sums, strict=True):
                    rate = m["adam"].step(found[2:] / found[0])
                    m["taken"].append((batch[at[0]] + 1, found[1], found[0], rate))
        for m in models:
            adam = m["adam"]
            m["done"], m["weights"] = adam.done, adam.weights.tobytes()
            m["moments"] = np.concatenate([adam.first, adam.second]).tobytes()
            m["steps"] += np.array(m["taken"], float).tobytes()
        return pa.Table.from_pylist([{n: m[n] for n in _STATE_TYPE.names} for m in models], _STATE_TYPE)

    return through


_STATE_TYPE = pa.schema([
    ("experiment_name", pa.string()), ("run_fold", pa.int32()), ("run", pa.int32()), ("done", pa.int32()),
    ("weights", pa.binary()), ("moments", pa.binary()), ("steps", pa.binary()),
])


def _gradients(weights: np.ndarray, layers: Sequence[int], counts: np.ndarray, idf: np.ndarray, labels: np.ndarray) -> np.ndarray:
    loss, gradient = loss_and_gradient(weights, layers, counts, idf, labels)
    return np.concatenate([[len(labels), loss], gradient])


def _confusion(weights: np.ndarray, layers: Sequence[int], counts: np.ndarray, idf: np.ndarray, labels: np.ndarray) -> np.ndarray:
    predicted = logits(weights, layers, counts, idf)[-1].argmax(axis=1)
    return np.bincount(labels * layers[-1] + predicted, minlength=layers[-1] ** 2).astype(np.float64)


def _pass(rows, runs, now, moving, idf, of, chosen, block, parts) -> dict[int, np.ndarray]:
    """One job over ``rows`` with the weights the runs ``now`` have."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast([
        (moving[i].weights, runs[i].layers, idf[runs[i].experiment, runs[i].fold]) for i in now
    ])

    def one(k: int, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
        weights, layers, scale = shared.value[k]
        return of(weights, layers, counts, scale, labels.astype(np.int64))

    found = summed(rows, [runs[i] for i in now], chosen, one, block, parts)
    shared.unpersist()
    return found


# ---- prediction

SCORED = "array<struct<model_key: string, label_id: int, max_logit: double, max_prob: double, inference_time_sec: double>>"


def predict(rows: DataFrame, fitted: Sequence[Fitted], classes: dict[str, list[str]], label: str, block: int) -> DataFrame:
    """``rows`` once for each model whose run has them as test rows (``fold``), with predicted and gold
    label, largest logit, largest probability and the seconds a row took inside the model.

    Time is taken around the model alone; a row has its share of that of its block.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast([(f.run, f.weights, f.idf) for f in fitted])

    @F.arrow_udf(SCORED)
    def score(experiment: pa.Array, fold: pa.Array, slots: pa.Array) -> pa.Array:
        by_run: dict[tuple, list] = {}
        for run, weights, idf in shared.value:
            by_run.setdefault((run.experiment, run.fold), []).append((run, weights, idf))
        names, folds = experiment.to_pylist(), fold.to_numpy(zero_copy_only=False)
        keys = np.array([f"{f}\0{n}" for f, n in zip(folds.tolist(), names, strict=True)], object)
        out: list[list[dict]] = [[] for _ in names]
        for key in dict.fromkeys(keys.tolist()):
            number, _, name = key.partition("\0")
            at = np.flatnonzero(keys == key)
            for run, weights, idf in by_run.get((name, int(number)), []):
                size = _rows_at_once(block, run.layers[0])
                for i in range(0, len(at), size):
                    mine = at[i:i + size]
                    start = time.perf_counter()
                    z = logits(weights, run.layers, words_of(slots, mine, run.layers[0]), idf)[-1]
                    best, p = z.argmax(axis=1), probabilities(z).max(axis=1)
                    each = (time.perf_counter() - start) / len(mine)
                    for r, c, m, q in zip(mine.tolist(), best.tolist(), z.max(axis=1).tolist(), p.tolist(), strict=True):
                        out[r].append({"model_key": run.model_key, "label_id": c, "max_logit": m, "max_prob": q, "inference_time_sec": each})
        return pa.array(out, _SCORED_TYPE)

    labels = F.create_map(*[x for e, names in classes.items() for x in (F.lit(e), F.array(*map(F.lit, names)))])
    scored = rows.withColumn("_scored", F.explode(score("experiment_name", "fold", "slots")))
    return scored.withColumns({
        "model_key": F.col("_scored.model_key"),
        "predicted_label": F.element_at(labels[F.col("experiment_name")], F.col("_scored.label_id") + 1),
        "max_logit": F.col("_scored.max_logit"),
        "max_prob": F.col("_scored.max_prob"),
        "inference_time_sec": F.col("_scored.inference_time_sec"),
        "gold_label": F.col(label),
    }).drop("_scored", "slots")


_SCORED_TYPE = pa.list_(pa.struct([
    ("model_key", pa.string()), ("label_id", pa.int32()), ("max_logit", pa.float64()), ("max_prob", pa.float64()),
    ("inference_time_sec", pa.float64()),
]))
