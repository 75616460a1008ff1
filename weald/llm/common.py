"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python code at a time; bounds a worker's memory whatever the Arrow batch size is.
SLICE_ROWS = 512
#: Text bytes handed to Python code at a time (a single longer text still goes alone).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a temporary one on a local master (tests), else an error,
    as executors don't see one another's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("weald.local.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weald-")
        spark.conf.set("weald.local.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, every executor sees it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weald-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weald_path = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    path = getattr(df, "weald_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or where df has a column of that name (whatever its case) name_2, name_3, ...: for columns of an operator's own."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(2, len(taken) + 3))) if n.lower() not in taken)


def positional(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: no name of its columns, whatever it is, can then meet one of an operator's own."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def named(df: DataFrame, name: str) -> str:
    """What positional() calls a column of df."""
    return f"c{df.columns.index(name)}"


def scanned(df: DataFrame) -> bool:
    """Whether df is a table scan under projections and filters at most, so that its rows come in the same partitions and
    order whenever it is computed."""

    def plain(plan) -> bool:
        below = plan.children()
        return plan.nodeName() in ("LogicalRelation", "Project", "Filter", "SubqueryAlias") and plan.deterministic() and all(plain(below.apply(k)) for k in range(below.size()))

    return plain(df._jdf.queryExecution().analyzed())


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string, which it has no function for."""
    byte = "list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    step = f"lambda c, b: xor(c >> 8, (list_transform(range(256), lambda i: {byte}))[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), {step}), 4294967295)"


def give_back() -> None:
    """Returns a worker's free memory to the system: workers outlive their tasks and are used again by other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow, giving back its memory when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch, text: int | None = None, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut so that a slice has at most most_rows rows and about most_bytes of column `text`."""
    if text is None:
        for at in range(0, batch.num_rows, most_rows):
            yield batch.slice(at, most_rows)
        return
    sizes = pa.compute.binary_length(batch.column(text)).to_pylist()
    begin, total = 0, 0
    for at, n in enumerate(sizes):
        if at > begin and (total + (n or 0) > most_bytes or at - begin >= most_rows):
            yield batch.slice(begin, at - begin)
            begin, total = at, 0
        total += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: int | None = None) -> DataFrame:
    """A narrow Arrow map: f sees bounded slices, nothing is shuffled, a lost task is simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  (pa.compute)

        for batch in batches:
            for part in slices(batch, text):
                if part.num_rows:
                    yield f(part)

    return df.mapInArrow(tidy(run), schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where=None) -> DataFrame:
    """At most `rows` labelled texts (text, label), the least by a hash of the id: one sample whatever the partitioning.

    Rows whose id, label or text is null take no part. If an id has several labels, its greatest counts; if it has several
    texts, the least by hash.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    # the sample is bounded by `rows` ids, so its broadcast is too
    found = texts.join(F.broadcast(chosen), "doc_id")
    # least hash before the text itself, so that the choice is an aggregate with one text a group
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text")).alias("t")).select("doc_id", F.col("t.text").alias("text"), "label")
