"""A Spark data source that writes each thread record to an indented JSON file of its own.

Tasks write below a hidden folder. When all of them are done, the commit moves the files to their place
and lists them in a manifest; a job that fails removes the hidden folder. So a file that a failed task
left is never seen, and what the manifest lists is whole. Tasks get records as Arrow batches and turn
one record at a time into Python objects, which are some ten times as large.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "thread_files"
MANIFEST = "post_id string, part bigint, n_parts bigint, dump_id string, file string"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def file_name(post_id: str, part: int, n_parts: int) -> str:
    """``<post>.json``; of a thread in several records the later ones carry their number."""
    return f"{quote(post_id, safe='')}.json" if n_parts <= 1 or not part else f"{quote(post_id, safe='')}.part-{part:05}.json"


class ThreadFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/.staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(self._staging(root), recursive=True)
        files = []
        for record in (batch.slice(i, 1).to_pylist()[0] for batch in iterator for i in range(batch.num_rows)):
            dump = record.get("dump_id")
            post, part, n = record["submission"]["id"], record.get("part") or 0, record.get("n_parts") or 1
            if n == 1:  # a whole thread needs no numbers
                record = {k: v for k, v in record.items() if k not in ("part", "n_parts", "dump_id")}
            name = file_name(post, part, n)
            with system.open_output_stream(f"{self._staging(root)}/{name}") as out:
                out.write(json.dumps(record, indent=2, ensure_ascii=False).encode("utf-8"))
            files.append({"post_id": post, "part": part, "n_parts": n, "dump_id": dump, "file": name})
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _open(self.path)
        files = [f for m in messages if m for f in m.files]
        for f in files:
            target = f"{root}/{f['file']}"
            if system.get_file_info(target).type != fs.FileType.NotFound:
                system.delete_file(target)
            system.move(f"{self._staging(root)}/{f['file']}", target)
        if files:
            system.create_dir(f"{root}/manifest", recursive=True)
            with system.open_output_stream(f"{root}/manifest/{self.run}.json") as out:
                out.write("".join(json.dumps(f, ensure_ascii=False) + "\n" for f in files).encode("utf-8"))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, root = _open(self.path)
        if system.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(root))


class ThreadFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ThreadFilesWriter:
        if overwrite:
            raise ValueError("thread files are only added to")
        return ThreadFilesWriter(self.options["path"])


def write_thread_files(documents: DataFrame, path: str) -> None:
    """One indented JSON file per thread record below ``path``, an absolute path or URI that all
    executors reach; a file of the same thread is replaced. Meant for as many threads as one
    folder can list: the commit moves file by file."""
    documents.sparkSession.dataSource.register(ThreadFiles)
    documents.write.format(FORMAT).mode("append").save(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, dump_id): threads all of whose records are in ``path``; none before the first commit."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "post_id string, dump_id string")
    return rows.groupBy("post_id", "dump_id").agg(
        F.countDistinct("part").alias("have"), F.max("n_parts").alias("n_parts")
    ).where("have = n_parts").select("post_id", "dump_id")
