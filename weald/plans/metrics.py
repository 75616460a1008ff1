"""What Spark itself has measured."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shuffled(spark: SparkSession) -> dict[str, int]:
    """Bytes that each executor has written for shuffles so far."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator()
    out = {}
    while every.hasNext():
        one = every.next()
        out[one.id()] = one.totalShuffleWrite()
    return out


def settle(spark: SparkSession) -> None:
    """Waits until the events of tasks that have ended are counted."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
