"""Binary edge files as a data source of Spark's: `spark.read.format("edge_records")`, and writers that commit.

Options: path, a file or a folder of files of 9-byte records. A reader gives the columns of the schema that is asked for
(`.schema("weight bigint")` reads no others), in partitions of ranges of whole records. Writers, of tables and of streams,
put each task's records into a file that becomes visible when all tasks have ended: a task that is run again, or a job that
fails, leaves nothing behind. A stream's batch that is written again replaces its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import basename

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from weald.schema import EDGE
from weald.sources.files import PIECE, RANGE, RECORD, opened, records_of

FORMAT = "edge_records"


@dataclass
class RecordRange(InputPartition):
    path: str
    begin: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    part: int
    records: int


def visible(fs, path: str) -> list:
    """The files at a path, or in it if it is a folder, less hidden ones."""
    from pyarrow.fs import FileSelector, FileType

    one = fs.get_file_info(path)
    if one.type == FileType.NotFound:
        return []
    found = [one] if one.is_file else fs.get_file_info(FileSelector(path))
    return [f for f in found if f.is_file and f.base_name[0] not in "._"]


class RecordReader(DataSourceReader):
    def __init__(self, uri: str, columns: list[str]):
        self.uri, self.columns = uri, columns

    def partitions(self) -> list[RecordRange]:
        fs, path = opened(self.uri)
        found = visible(fs, path)
        if not found and not fs.get_file_info(path).is_file and fs.get_file_info(path).type.name == "NotFound":
            raise ValueError(f"no such file: {self.uri}")
        for f in found:
            if f.size % RECORD.itemsize:
                raise ValueError(f"{f.path} ends within a record")
        ranges = [RecordRange(f.path, at, min(RANGE, f.size - at)) for f in found for at in range(0, f.size, RANGE)]
        return ranges or [RecordRange("", 0, 0)]

    def read(self, of: RecordRange) -> Iterator[pa.RecordBatch]:
        if not of.size:
            return
        fs, _ = opened(self.uri)
        with fs.open_input_file(of.path) as source:
            for at in range(of.begin, of.begin + of.size, PIECE):
                x = np.frombuffer(source.read_at(min(PIECE, of.begin + of.size - at), at), RECORD)
                yield pa.RecordBatch.from_arrays([pa.array(x[c].astype(np.int64)) for c in self.columns], self.columns)


class _Writer:
    """What both writers share: hidden files of a run, and moving them in place."""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.run = uri, overwrite, uuid.uuid4().hex
        fs, path = opened(uri)
        fs.create_dir(path, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = opened(self.uri)
        own, records = f"{path}/.{self.run}-{task.partitionId():05d}-{uuid.uuid4().hex}", 0
        out = None
        for batch in batches:
            out = out or fs.open_output_stream(own)
            out.write(records_of(batch).tobytes())
            records += batch.num_rows
        if out:
            out.close()
        return Written(own if out else "", task.partitionId(), records)

    def placed(self, messages: list[Written | None], name: str, old) -> None:
        """The files of the messages under their final names, in place of those that `old` says are outdated."""
        fs, path = opened(self.uri)
        for f in visible(fs, path):
            if old(f.base_name):
                fs.delete_file(f.path)
        for m in messages:
            if m is not None and m.path:
                fs.move(m.path, f"{path}/{name}-{m.part:05d}.bin")
        self.swept()

    def swept(self) -> None:
        """Deletes what attempts of this run have left."""
        from pyarrow.fs import FileSelector

        fs, path = opened(self.uri)
        for f in fs.get_file_info(FileSelector(path)):
            if basename(f.path).startswith(f".{self.run}-"):
                fs.delete_file(f.path)


class RecordWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.placed(messages, f"part-{self.run}", lambda name: self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        self.swept()


class RecordStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.placed(messages, f"batch-{batchId:08d}", lambda name: name.startswith(f"batch-{batchId:08d}-"))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.swept()


class EdgeRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return EDGE

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError(f"{FORMAT} needs a path")
        return self.options["path"]

    def reader(self, schema: StructType) -> RecordReader:
        wrong = [f.name for f in schema.fields if f.name not in RECORD.names or f.dataType.simpleString() != "bigint"]
        if wrong:
            raise ValueError(f"{FORMAT} has u, v and weight as bigint, not {wrong}")
        return RecordReader(self._path(), [f.name for f in schema.fields])

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self._path(), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> RecordStreamWriter:  # noqa: N802
        return RecordStreamWriter(self._path(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(EdgeRecords)
