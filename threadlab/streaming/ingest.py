"""Incremental ingest of landed thread records.

A thread is stored once, as one whole dump: its first that is complete. Parts of a dump wait in
keyed state until all are there, in whatever batches they come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadlab.operators.threads import flatten_threads, thread_edges
from threadlab.sources.schemas import THREADS

PART = ["post_id", "part"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = "submission struct<id: string>, part bigint, n_parts bigint, dump_id string"
LANDED = "post_id string, part bigint, record string"


class WholeDumps(StatefulProcessor):
    """Holds the parts of each dump of a thread; emits the first dump that is complete, once.

    Of dumps that become complete in one batch the one with the most parts goes first, then the one
    with the lowest id. A part that lands again is the same part. One record is in memory at a time
    besides those of the batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "dump_id string")
        self.records = handle.getMapState("records", "dump_id string, part bigint", "record string")
        self.sizes = handle.getMapState("sizes", "dump_id string", "have bigint, n_parts bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        complete = set()
        for frame in rows:
            for dump, part, n, record in zip(frame["dump_id"], frame["part"], frame["n_parts"], frame["record"], strict=True):
                place, dump, n = (dump, int(part)), (dump,), int(n)
                if not self.records.containsKey(place):
                    self.records.updateValue(place, (record,))
                    have = self.sizes.getValue(dump)[0] + 1 if self.sizes.containsKey(dump) else 1
                    self.sizes.updateValue(dump, (have, n))
                    if have == n:
                        complete.add((-n, dump[0]))
        if not complete:
            return
        n, dump = min(complete)
        for part in range(-n):
            (record,) = self.records.getValue((dump, part))
            yield pd.DataFrame({"post_id": [key[0]], "part": [part], "record": [record]})
        self.done.update((dump,))
        self.records.clear()
        self.sizes.clear()

    def close(self) -> None:
        pass


def read_table(spark: SparkSession, output: str, table: str) -> DataFrame:
    """One of the tables ``posts``, ``comments`` and ``edges``: the rows of finished batches."""
    finished = spark.read.parquet(f"{output}/parts").select("source_id", "batch").distinct()
    rows = spark.read.parquet(f"{output}/{table}").join(finished, ["source_id", "batch"], "left_semi")
    return rows.drop("source_id", "batch")


def _landed(spark: SparkSession, landing: str) -> DataFrame:
    """Whole dumps of the threads whose JSON lines arrive: (post_id, part, record).

    A record without ``n_parts`` is a whole thread. Lines that are no thread record are left out, and
    so are parts beyond the number of parts.
    """
    lines = spark.readStream.text(landing).select(F.from_json("value", NAMES).alias("n"), F.col("value").alias("record"))
    whole = F.col("n.n_parts").isNull()
    named = lines.select(
        F.col("n.submission.id").alias("post_id"),
        F.when(whole, F.xxhash64("record").cast("string")).otherwise(F.coalesce("n.dump_id", F.lit(""))).alias("dump_id"),
        F.when(whole, 0).otherwise(F.coalesce("n.part", F.lit(0))).cast("bigint").alias("part"),
        F.coalesce("n.n_parts", F.lit(1)).cast("bigint").alias("n_parts"),
        "record",
    ).where("post_id is not null and part >= 0 and part < n_parts")
    return named.groupBy("post_id").transformWithStateInPandas(
        statefulProcessor=WholeDumps(), outputStructType=LANDED, outputMode="Append", timeMode="None"
    )


def ingest_threads(spark: SparkSession, landing: str, output: str, checkpoint: str) -> None:
    """Process the thread files that arrived since the last call, then stop.

    The checkpoint remembers files, and parts of dumps that are not complete.  A thread already in the
    output is left alone, so one that is dumped again, grown or not, changes nothing, even with
    a new checkpoint.  A batch owns one folder per run and batch number and replaces it when retried.
    The run is named inside the checkpoint: a checkpoint that lost its contents starts a new run and
    never replaces the folders of another.  ``parts`` is written last; without its rows a batch
    that failed half-way is not read.
    """
    source_id = _run_id(spark, checkpoint)

    def process(batch: DataFrame, batch_id: int) -> None:
        new = batch.select(*PART, F.from_json("record", THREADS).alias("r")).select(*PART, "r.submission", "r.comments", "r.reply_network")
        done = _done_elsewhere(batch.sparkSession, output, source_id, batch_id)
        if done is not None:
            new = new.join(done, "post_id", "left_anti")
        new = new.persist()
        tables = {
            "comments": flatten_threads(new),
            "edges": thread_edges(new),
            "posts": new.filter("part = 0").select("post_id", "submission.*"),
            "parts": new.select(*PART),
        }
        try:
            for name, table in tables.items():
                folder = f"{output}/{name}/source_id=s{source_id}/batch={batch_id}"
                table.write.mode("overwrite").parquet(folder)
        finally:
            new.unpersist()

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # the query keeps the setting it starts with
    try:
        query = (
            _landed(spark, landing)
            .writeStream.foreachBatch(process)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run, kept in the checkpoint folder."""
    path = f"{checkpoint}/run-name"
    try:
        return spark.read.schema("name string").text(path).first()[0]
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    name = uuid.uuid4().hex[:12]
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(path)
    return name


def _done_elsewhere(
    spark: SparkSession, output: str, source_id: str, batch_id: int
) -> DataFrame | None:
    """Threads written by any other batch; None before the first."""
    try:
        parts = spark.read.parquet(f"{output}/parts")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    own = (F.col("source_id") == f"s{source_id}") & (F.col("batch") == batch_id)
    return parts.filter(~own).select("post_id").distinct()
