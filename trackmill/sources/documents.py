"""A data source for trees of small documents, one row per document.

Spark's own file sources never list files whose names start with an underscore, and write many
rows to a file. This source reads and writes documents one by one, on any file system that pyarrow
can open:

    spark.dataSource.register(Documents)
    spark.read.format("documents").option("file", "_scores.json").load(path)     # rel, name, value
    df.select("rel", "name", "value").write.format("documents").mode("append").save(path)

rel is the document's folder relative to the path. Reading plans one partition per folder: folders
are opened level by level until there are `parts` of them or none is left to open, so the driver
never lists the whole tree; what lies deeper is listed by the task that reads it. An unreadable document gives
a null value. `read_documents` lists in one step and opens in a second, over which the names are
dealt evenly, so a folder of any size is opened by all tasks (with "names", the source only lists);
`write_documents` deals its rows as evenly. Writing puts a document under a name of its own and then moves it in place, so a
repeated task replaces its own output.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "rel string, name string, value string"
PARTS = 256
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


@dataclass
class Folder(InputPartition):
    """Documents right in a folder, or in it and all below."""

    path: str
    deep: bool

    def __post_init__(self):
        InputPartition.__init__(self, (self.path, self.deep))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["path"], options.get("file", "*")
        self.parts = int(options.get("parts", PARTS))
        self.names = options.get("names", "false") == "true"

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        store, root = _open(self.root)
        if store.get_file_info(root).type != fs.FileType.Directory:
            return []
        flat, open_ = [], [root]
        while open_ and len(flat) + len(open_) < self.parts:
            below = []
            for folder in open_:
                flat.append(folder)
                below += [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.Directory]
            open_ = below
        return [Folder(f, False) for f in flat] + [Folder(f, True) for f in open_]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = _open(self.root)
        rows, size = [], 0
        for f in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep)):
            if f.type != fs.FileType.File or not fnmatch.fnmatchcase(f.base_name, self.pattern):
                continue
            value = None if self.names else _text(store, f.path)
            rows.append((f.path[len(root) :].strip("/").rpartition("/")[0], f.base_name, value))
            size += len(value or "")
            if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _text(store, path: str) -> str | None:
    try:
        with store.open_input_stream(path) as stream:
            return stream.read().decode("utf-8", "replace")
    except OSError:
        return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["rel", "name", "value"])


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        store, root = _open(self.root)
        made = set()
        for rel, name, value in iterator:
            folder = f"{root}/{rel}" if rel else root
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write((value or "").encode())
            store.move(part, f"{folder}/{name}")
        return WriterCommitMessage()


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("documents are appended; one of the same name is replaced")
        return Writer(self.options)


def read_documents(spark: SparkSession, uri: str, file: str) -> DataFrame:
    """rel, name, value of the documents whose names match `file` (a shell pattern), below a path with its scheme."""
    spark.dataSource.register(Documents)
    names = spark.read.format("documents").option("file", file).option("names", "true").load(uri).select("rel", "name")

    def opened(batches):
        store, root = _open(uri)
        for batch in batches:
            rows, size = [], 0
            for rel, name in zip(batch.column("rel").to_pylist(), batch.column("name").to_pylist(), strict=True):
                value = _text(store, f"{root}/{rel}/{name}" if rel else f"{root}/{name}")
                rows.append((rel, name, value))
                size += len(value or "")
                if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return names.repartition(_tasks(spark), F.xxhash64("rel", "name")).mapInArrow(opened, SCHEMA)


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_documents(rows: DataFrame, uri: str) -> None:
    """Write rows(rel, name, value) as one document each."""
    rows.sparkSession.dataSource.register(Documents)
    dealt = rows.select("rel", "name", "value").repartition(_tasks(rows.sparkSession), F.xxhash64("rel", "name"))
    dealt.write.format("documents").mode("append").save(uri)
