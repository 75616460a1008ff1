"""Edge files: weighted binaries, MatrixMarket, and files of run configurations."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weald.sources.generators import MAX_WEIGHT, weighted

#: Bytes of a record: two unsigned 32-bit ids and an unsigned 8-bit weight, little-endian.
RECORD = np.dtype([("u", "<u4"), ("v", "<u4"), ("weight", "u1")])


#: Bytes of a file that a task reads as one, and of the pieces that it holds.
RANGE, PIECE = RECORD.itemsize << 23, RECORD.itemsize << 17


def _hadoop(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def opened(uri: str):
    """The file system and path of a URI, for use in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def read_binary(spark: SparkSession, *paths: str) -> DataFrame:
    """(u, v, weight) of files of 9-byte records, in any order. Paths may be folders or patterns.

    The driver lists files and sizes only; each range of whole records is read by a task, piece by piece. A file that
    ends within a record is an error.
    """
    ranges = []
    for path in paths:
        at, fs = _hadoop(spark, path)
        found = fs.globStatus(at)
        if not found:
            raise ValueError(f"no such file: {path}")
        for one in (f for g in found for f in (fs.listStatus(g.getPath()) if g.isDirectory() else [g])):
            if one.getPath().getName()[0] in "._":
                continue
            size = one.getLen()
            if size % RECORD.itemsize:
                raise ValueError(f"{one.getPath()} ends within a record")
            ranges += [(one.getPath().toString(), begin, min(RANGE, size - begin)) for begin in range(0, size, RANGE)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, begin, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, path = opened(uri)
                with fs.open_input_file(path) as source:
                    for at in range(begin, begin + size, PIECE):
                        x = np.frombuffer(source.read_at(min(PIECE, begin + size - at), at), RECORD)
                        yield pa.RecordBatch.from_arrays([pa.array(x[c].astype(np.int64)) for c in ("u", "v", "weight")], ["u", "v", "weight"])

    listed = spark.createDataFrame(ranges, "path string, begin bigint, size bigint")
    return listed.repartition(max(1, len(ranges)), "path", "begin").mapInArrow(read, "u bigint, v bigint, weight bigint")


def records_of(batch: pa.RecordBatch) -> np.ndarray:
    """The records of a batch (u, v, weight). Ids and weights that don't fit are an error."""
    columns = [batch.column(c).to_numpy() for c in ("u", "v", "weight")]
    out = np.empty(batch.num_rows, RECORD)
    for name, c, most in zip(("u", "v", "weight"), columns, (2**32, 2**32, 256), strict=True):
        if len(c) and (c.min() < 0 or c.max() >= most):
            raise ValueError("an id or weight does not fit the record")
        out[name] = c
    return out


def to_records(edges: DataFrame) -> DataFrame:
    """(data): one binary of records for each Arrow batch of edges. Ids and weights that don't fit are an error."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([records_of(b).tobytes()], pa.binary())], ["data"])

    return edges.select("u", "v", "weight").mapInArrow(encode, "data binary")


def write_binary(edges: DataFrame, folder: str) -> int:
    """Files of records, part-00000.bin and so on, one for each partition that has any; returns the number of records.

    Tasks write them to a folder that all executors share; one that is run again writes the same file anew, under a
    name of its own until it is complete.
    """
    spark = edges.sparkSession
    at, hadoop = _hadoop(spark, folder)
    hadoop.mkdirs(at)
    place = hadoop.makeQualified(at).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = opened(place)
        final, rows = f"{path}/part-{task.partitionId():05d}.bin", 0
        own = f"{path}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out = None
        for b in batches:
            out = out or fs.open_output_stream(own)
            out.write(records_of(b).tobytes())
            rows += b.num_rows
        if out:
            out.close()
            fs.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["records"])

    counted = edges.select("u", "v", "weight").mapInArrow(write, "records bigint")
    return counted.agg(F.coalesce(F.sum("records"), F.lit(0))).collect()[0][0]


def decode_records(records: DataFrame) -> DataFrame:
    """(u, v, weight) of to_records()."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), RECORD)
            yield pa.RecordBatch.from_arrays([pa.array(x[c].astype(np.int64)) for c in ("u", "v", "weight")], ["u", "v", "weight"])

    return records.select("data").mapInArrow(parse, "u bigint, v bigint, weight bigint")


def read_matrix_market(spark: SparkSession, path: str, seed: int = 0, most: int = MAX_WEIGHT) -> DataFrame:
    """(u, v, weight) of an unweighted MatrixMarket file: ids from 0, weights drawn by a hash.

    Lines that begin with % are comments. The size line is the one line with three numbers; entries have two.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    pairs = lines.where(F.size(parts) == 2).select((parts[0].cast("bigint") - 1).alias("u"), (parts[1].cast("bigint") - 1).alias("v"))
    return weighted(pairs, seed, most)


def write_matrix_market(edges: DataFrame, folder: str) -> None:
    """A folder of text that together is an unweighted MatrixMarket matrix of the edges' pattern, ids counted from 1."""
    size, entries = edges.agg(F.coalesce(F.max(F.greatest("u", "v")) + 1, F.lit(0)), F.count("*")).collect()[0]
    head = edges.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate pattern symmetric",), (f"{size} {size} {entries}",)], "value string")
    rows = edges.select(F.concat_ws(" ", (F.greatest("u", "v") + 1).cast("string"), (F.least("u", "v") + 1).cast("string")).alias("value"))
    head.unionByName(rows).write.text(folder)


def read_configs(text: str) -> list[dict]:
    """One run a line: --graphtype, --log_n, --log_m, --gamma, --distance_type, --max_edge_weight, --seed, --algorithm and so on."""
    out = []
    for line in text.splitlines():
        words = shlex.split(line, comments=True)
        if not words:
            continue
        own: dict = {}
        at = 0
        while at < len(words):
            if not words[at].startswith("--"):
                raise ValueError(f"not an option: {words[at]}")
            name, sep, value = words[at][2:].partition("=")
            if not sep:
                at += 1
                if at == len(words):
                    raise ValueError(f"--{name} lacks a value")
                value = words[at]
            own[name] = int(value) if value.lstrip("-").isdigit() else float(value) if value.replace(".", "", 1).isdigit() else value
            at += 1
        out.append(own)
    return out
