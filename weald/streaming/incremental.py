"""A forest kept up to date under a stream of edges: MSF(old + batch) = MSF(MSF(old) + batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weald.plans.engine import Log, msf
from weald.plans.staging import shared_folder
from weald.schema import EDGE


class ForestKeeper:
    """foreachBatch target. `current` is the forest of all edges of the batches so far; edges are only added.

    Each batch works on the forest before it and the batch, not on the history. Forests are tables named by batch in
    `folder`, which outlives the driver: a query that resumes from its checkpoint finds the forest of the last batch
    there. A batch that is delivered again starts from the forest before it and writes its own anew.
    """

    def __init__(self, folder: str | None = None, **how):
        self.folder, self.how = folder, how

    def _place(self, spark: SparkSession):
        if self.folder is None:
            self.folder = f"{shared_folder(spark)}/forests-{id(self):x}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self, spark: SparkSession) -> list[int]:
        """The batches whose forests are there and complete, in order."""
        path, fs = self._place(spark)
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        complete = spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[6:]) for n in names if n.startswith("batch-") and fs.exists(complete(f"{self.folder}/{n}/_SUCCESS")))

    def _read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(EDGE).parquet(f"{self.folder}/batch-{batch_id}")

    @property
    def current(self) -> DataFrame | None:
        spark = SparkSession.active()
        known = self.batches(spark)
        return self._read(spark, known[-1]) if known else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("u", "v", "weight")
        before = [n for n in self.batches(spark) if n < batch_id]
        old = self._read(spark, before[-1]).unionByName(new) if before else new
        log = Log()
        msf(old, log=log, **self.how).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")
        log.drop()
        _, fs = self._place(spark)
        for n in before[:-1]:  # the one before stays, in case this batch is delivered again
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-{n}"), True)


def maintain(edges: DataFrame, keeper: ForestKeeper, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query that feeds the streaming table `edges` (u, v, weight) to the keeper, whose forests are kept beside
    the query's checkpoint unless it has a folder already."""
    if keeper.folder is None:
        keeper.folder = f"{checkpoint.rstrip('/')}-forests"
    return edges.writeStream.foreachBatch(keeper).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
