"""Session set-up and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_SCRATCH: dict[str, str] = {}
_LOCK = threading.Lock()
_WRITES: dict[str, str | int] = {"open": 0}
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def get_spark(app: str = "threadlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for (UTC, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Without that setting only a master inside this process (tests) may use a temporary folder; on a
    cluster, ``local-cluster`` included, a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/threadlab"
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="threadlab-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query. Threads share the setting: the last one restores it."""
    with _LOCK:
        if not _WRITES["open"]:
            _WRITES["before"] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _WRITES["open"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITES["open"] -= 1
            if not _WRITES["open"]:
                spark.conf.set(CLEANUP, _WRITES["before"])


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: cuts lineage, survives lost executors.

    Unlike an eager checkpoint it computes the input once, and later readers get column
    pruning and size statistics. The shuffle files of the write go when it ends; otherwise a job
    of many steps keeps those of all steps until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffle_cleanup(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``table``.

    Only for a table whose every reader has been written itself: a task that runs again after its
    executor was lost reads its input again.
    """
    path = _FOLDERS.pop(table, None)
    if path:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
