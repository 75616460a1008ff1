"""Intermediate tables in the shared folder: they cut lineage, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN = "weald.staging.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset: a temporary folder on a local master (tests), else an error,
    as executors don't see one another's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weald-")
        spark.conf.set(_OWN, found)
    return found.rstrip("/")


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def counted(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation | None]:
    """df, and what will know the aggregates `counts` of its rows once it has been written: no job of their own."""
    if not counts:
        return df, None
    seen = Observation()
    return df.observe(seen, *(c.alias(k) for k, c in counts.items())), seen


class Stage:
    """A written table. `df` reads it, `counts` has the aggregates asked for; drop() deletes its files once nothing reads it."""

    def __init__(self, df: DataFrame, name: str, **counts: Column):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df, seen = counted(df, counts)
        df.write.parquet(self.path)
        self.counts = dict.fromkeys(counts) | (seen.get if seen else {})
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        deleted(self.spark, self.path)


class Bucketed:
    """A written table whose rows with equal `by` lie in one of `buckets` buckets, so that grouping by it needs no exchange;
    `split` is a boolean column by which the files are divided, so that either part is read alone."""

    def __init__(self, df: DataFrame, name: str, buckets: int, by: str, split: str, **counts: Column):
        self.spark = df.sparkSession
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        df, seen = counted(df, counts)
        df.write.format("parquet").option("path", self.path).partitionBy(split).bucketBy(buckets, by).saveAsTable(self.name)
        self.counts = dict.fromkeys(counts) | (seen.get if seen else {})
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        deleted(self.spark, self.path)
