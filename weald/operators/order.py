"""Numbering, sorting, partitioning and pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weald.operators.edges import lightest, pack
from weald.plans.staging import Stage

#: The total order of edges on original ends. It makes the minimum spanning forest unique.
TOTAL_ORDER = ("weight", "u", "v")


def ranked(edges: DataFrame) -> Stage:
    """edges with eid, a long that grows in the total order: the order and the identity of an edge in one number.

    A range-partitioned sort, whose partitions' numbers are the high bits of the ids; no single-partition window. The
    sorted table is written, so that the sampled range bounds, and with them the ids, are settled.
    """
    return Stage(edges.orderBy(*TOTAL_ORDER).withColumn("eid", F.monotonically_increasing_id()), "ranked")


class Identified:
    """A table of edges (u < v) that gives each an eid, a long that grows in the total order: `df` (u, v, weight, eid).

    Where the weight and both ends fit a long together, eid is these three in one number: nothing is sorted, parallel edges may
    stay (they have ids of their own, equal edges equal ones), and edges are read from their ids alone. Else of parallel edges
    the lightest is kept, eid comes from a global sort, and edges are found by a semi-join.
    """

    def __init__(self, edges: DataFrame):
        self.stage = Stage(edges.select("u", "v", "weight"), "edges", edges=F.count("*"), end=F.max("v"), weight=F.max("weight"))
        self.size, counts = self.stage.counts["edges"] or 0, self.stage.counts
        self.bits = (counts["end"] or 0).bit_length()
        self.packed = (counts["weight"] or 0).bit_length() + 2 * self.bits <= 63
        if self.packed:
            self.df = self.stage.df.withColumn("eid", pack(pack(F.col("weight"), F.col("u"), self.bits), F.col("v"), self.bits))
        else:
            given, self.stage = self.stage, ranked(lightest(self.stage.df))
            given.drop()
            self.df = self.stage.df

    def edges_of(self, ids: DataFrame) -> DataFrame:
        """(u, v, weight) of ids (eid), each of which is given once."""
        if not self.packed:
            return self.df.join(ids.select("eid"), "eid", "left_semi").select("u", "v", "weight")
        end = F.lit((1 << self.bits) - 1).cast("bigint")
        return ids.select(F.shiftright("eid", self.bits).bitwiseAND(end).alias("u"), F.col("eid").bitwiseAND(end).alias("v"), F.shiftright("eid", 2 * self.bits).alias("weight"))

    def drop(self) -> None:
        self.stage.drop()


def numbered(df: DataFrame, *order: str, name: str = "eid") -> DataFrame:
    """df with dense numbers 0, 1, ... in the given order.

    Partitions of a range-partitioned sort are numbered for themselves; their offsets, one row a partition, come from a
    prefix sum over the written table's partition counts. No window over all rows.
    """
    stage = Stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = stage.df.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    small = F.broadcast(offsets.select("_part", "_offset"))  # one row a partition
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return stage.df.withColumn("_part", part).join(small, "_part").select(*df.columns, (F.col("_offset") + within).cast("bigint").alias(name))


def dense_vertices(edges: DataFrame) -> DataFrame:
    """(vertex, idx): the vertices that edges touch, numbered 0, 1, ... in order."""
    return numbered(edges.select(F.explode(F.array("u", "v")).alias("vertex")).distinct(), "vertex", name="idx")


def densified(edges: DataFrame) -> DataFrame:
    """edges with dense vertex numbers in place of their ends."""
    ids = Stage(dense_vertices(edges), "dense").df
    out = edges.join(ids.select(F.col("vertex").alias("u"), F.col("idx").alias("a")), "u").join(ids.select(F.col("vertex").alias("v"), F.col("idx").alias("b")), "v")
    return out.select(F.col("a").alias("u"), F.col("b").alias("v"), *(c for c in edges.columns if c not in ("u", "v")))


def first_of_run(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def range_partitioned(arcs: DataFrame, parts: int, *by: str) -> DataFrame:
    """Rows dealt by ranges of the keys and sorted within their partition: equal keys of one column never part."""
    return arcs.repartitionByRange(parts, by[0]).sortWithinPartitions(*by)


#: Ranges whose bounds are broadcast at most (8 MB).
MOST_RANGES = 1_000_000


def located(df: DataFrame, column: str, bounds: DataFrame, name: str = "lower") -> DataFrame:
    """df with the greatest of the bounds (one column of longs, in any order) that is not above its column, null where there is
    none or the column is null: which range a vertex lies in, and so who owns it.

    The bounds, sorted, are broadcast (more than MOST_RANGES are an error), and each batch is looked up by one binary search:
    neither a product of tables nor an exchange.
    """
    found = bounds.where(F.col(bounds.columns[0]).isNotNull()).distinct().limit(MOST_RANGES + 1).toArrow().column(0).to_numpy()
    if len(found) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges")
    given = df.sparkSession.sparkContext.broadcast(np.sort(found.astype(np.int64)))
    at, names = df.columns.index(column), [f"c{k}" for k in range(len(df.columns) + 1)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = given.value
        for batch in batches:
            values = batch.column(at)
            place = np.searchsorted(lower, values.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right") - 1
            none = (place < 0) | values.is_null().to_numpy(zero_copy_only=False)
            owner = pa.array(lower[np.maximum(place, 0)] if len(lower) else np.zeros(len(place), np.int64), mask=none)
            yield pa.RecordBatch.from_arrays([*batch.columns, owner], names)

    plain = df.toDF(*names[:-1])
    schema = StructType([*plain.schema.fields, StructField(names[-1], LongType())])
    return plain.mapInArrow(look, schema).toDF(*df.columns, name)


def pivot(edges: DataFrame, share: float = 0.5, column: str = "weight", accuracy: int = 10_000) -> int | None:
    """About the given quantile of a column: a mergeable sketch, one number to the driver. None for an empty table."""
    return edges.agg(F.percentile_approx(column, share, accuracy)).collect()[0][0]


def balance(edges: DataFrame, at: int, column: str = "weight") -> tuple[int, int]:
    """How many edges are up to the pivot, and how many there are, in one pass."""
    light, total = edges.agg(F.count_if(F.col(column) <= at), F.count("*")).collect()[0]
    return light, total
