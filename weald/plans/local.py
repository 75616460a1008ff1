"""Forests within partitions: what is no forest edge of a part is none of the whole (cycle property)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.functions import forest

#: Edges that a task gathers before it reduces them to their forest; bounds its memory together with the vertices they touch.
CHUNK_EDGES = 2_000_000
#: Vertices of a graph whose forest may still be merged in one task.
MOST_VERTICES = 50_000_000


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() for n in names]


class Chunks:
    """Edges that come in batches, of which no more than a chunk and the forest so far are held. The third column is the eid,
    or (by_weight) the weight, with which u and v decide."""

    def __init__(self, by_weight: bool = False) -> None:
        self.held: list[list[np.ndarray]] = []
        self.size = 0
        self.by_weight = by_weight

    def add(self, *arrays: np.ndarray) -> None:
        self.held.append(list(arrays))
        self.size += len(arrays[0])
        if self.size > CHUNK_EDGES:
            self.held = [self.forest()]
            self.size = CHUNK_EDGES // 2 if len(self.held[0][0]) < CHUNK_EDGES // 2 else 0

    def forest(self) -> list[np.ndarray]:
        """u, v and the third column of the forest of all edges so far, in rising order: what is held from then on."""
        if not self.held:
            return [np.empty(0, np.int64)] * 3
        columns = list(zip(*self.held, strict=True))
        self.held = []
        # column by column, so that no more than one of them is there twice
        eid = np.concatenate(columns.pop())
        v = np.concatenate(columns.pop())
        u = np.concatenate(columns.pop())
        order = forest.order_of(u, v, eid) if self.by_weight else np.argsort(eid, kind="stable")
        eid = eid[order]
        v = v[order]
        u = u[order]
        del order
        names, (a, b) = forest.compact(u, v)
        keep, _ = forest.light_first(len(names), a, b)
        self.held = [[u[keep], v[keep], eid[keep]]]
        return self.held[0]


#: Edges of a part that near() makes about.
NEAR_EDGES = 250_000


def near(edges: DataFrame, size: int, width: int | None = None) -> DataFrame:
    """`size` edges, dealt out by ranges of (u, v): a part's edges share their ends, so that its forest has few of them. A part
    has `width` edges about, NEAR_EDGES if not given."""
    return edges.repartitionByRange(-(-size // (width or NEAR_EDGES)) or 1, "u", "v")


def reduced(edges: DataFrame, by: str = "eid") -> DataFrame:
    """edges (u, v, eid) less those that are not in the forest of their partition. Any partitioning is right. With by="weight"
    the edges are (u, v, weight) in the total order, not numbered yet, and parallel ones may be among them.

    A partition is read in chunks; each chunk is reduced together with what the ones before left, so a task holds at
    most a chunk and a forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(by == "weight")
        for batch in batches:
            chunks.add(*_arrays(batch, "u", "v", by))
        if chunks.held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in chunks.forest()], ["u", "v", by])

    return edges.select("u", "v", by).mapInArrow(run, f"u bigint, v bigint, {by} bigint")


def labelled(edges: DataFrame) -> DataFrame:
    """(vertex, component) of edges (u, v), loops included, in one task: for tables that fit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_arrays(b, "u", "v") for b in batches]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            names, (a, b) = forest.compact(u, v)
            _, label = forest.contract(len(names), a, b)
            least = np.full(len(names), len(names))
            np.minimum.at(least, label, np.arange(len(names)))  # names are in order
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[least[label]])], ["vertex", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "vertex bigint, component bigint")


def merged(edges: DataFrame, fan_in: int = 8, most_vertices: int = MOST_VERTICES) -> DataFrame:
    """The forest of edges (u, v, eid), by reducing partitions and merging about `fan_in` of them at a time until one is left.

    Every level has a shuffle of its own, so it runs in as many tasks as it has partitions. The last one holds the whole
    forest, whose size the vertices bound: graphs of more than most_vertices are an error (and a matter for Borůvka).
    """
    vertices = edges.select(F.explode(F.array("u", "v")).alias("x")).agg(F.approx_count_distinct("x", 0.02)).collect()[0][0]
    if vertices > most_vertices:
        raise ValueError(f"a forest over some {vertices} vertices is too large for one task; use boruvka or filter_boruvka")
    parts = edges.rdd.getNumPartitions()
    out = reduced(edges)
    while parts > 1:
        group = F.floor(F.spark_partition_id() / fan_in)
        parts = -(-parts // fan_in)
        out = reduced(out.withColumn("_group", group).repartition(parts, "_group") if parts > 1 else out.repartition(1))
    return out


def blocks(edges: DataFrame, count: int):
    """A function from an end to its block: `count` ranges of equal width over the ids that edges touch."""
    low, high = edges.agg(F.min(F.least("u", "v")), F.max(F.greatest("u", "v"))).collect()[0]
    width = 1 if low is None else max(1, -(-(high - low + 1) // count))
    return lambda end: F.floor((end - F.lit(low or 0)) / F.lit(width))


def local_share(edges: DataFrame, block) -> float:
    """The share of edges with both ends in one block."""
    inside, total = edges.agg(F.count_if(block(F.col("u")) == block(F.col("v"))), F.count("*")).collect()[0]
    return inside / total if total else 0.0


def contracted_locally(edges: DataFrame, parts: int, block=None) -> DataFrame:
    """(kind, a, b, eid): 'tree' rows with the eid of forest edges, and 'label' rows with vertex a and its label b.

    Vertices fall into blocks by ranges, and `parts` tasks take whole blocks. A component is contracted along its
    lightest edge within a block only if that comes before the component's lightest cut edge; such an edge is in the
    forest of the whole graph whatever the other blocks hold. Tasks get the lightest cut edge of each vertex, aggregated
    before the shuffle, and the edges within blocks, which they reduce to their forest chunk by chunk: what is not in
    that is in no forest, whatever is cut. So a task holds a chunk and its vertices, however many edges a hub has.
    """
    block = block or blocks(edges, 16 * parts)
    here, there = block(F.col("u")), block(F.col("v"))
    inner = edges.where(here == there).select(here.alias("block"), "u", "v", "eid", F.lit(True).alias("inner"))
    ends = F.explode(F.array(F.struct(here.alias("block"), F.col("u").alias("u")), F.struct(there.alias("block"), F.col("v").alias("u")))).alias("end")
    cut = edges.where(here != there).select(ends, "eid").groupBy("end.block", "end.u").agg(F.min("eid").alias("eid"))
    rows = inner.unionByName(cut.select("block", "u", F.col("u").alias("v"), "eid", F.lit(False).alias("inner")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, ends, cuts = Chunks(), [], []
        for batch in batches:
            u, v, eid = _arrays(batch, "u", "v", "eid")
            within = batch.column("inner").to_numpy(zero_copy_only=False)
            chunks.add(u[within], v[within], eid[within])
            ends.append(u[~within])
            cuts.append(eid[~within])
        if not ends:
            return
        u, v, eid = chunks.forest()
        names, (a, b, far) = forest.compact(u, v, np.concatenate(ends))
        # how many of the edges within come before a vertex's cut
        limit = np.full(len(names), len(eid))
        limit[far] = np.searchsorted(eid, np.concatenate(cuts))
        keep, label = forest.contract(len(names), a, b, limit)
        tree = eid[keep]
        moved = np.flatnonzero(label != np.arange(len(names)))
        none = np.zeros(len(tree), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["tree"] * len(tree) + ["label"] * len(moved)), *(pa.array(np.concatenate([none, names[x]])) for x in (moved, label[moved])), pa.array(np.concatenate([tree, np.zeros(len(moved), np.int64)]))],
            ["kind", "a", "b", "eid"],
        )

    return rows.repartition(parts, "block").select("u", "v", "eid", "inner").mapInArrow(run, "kind string, a bigint, b bigint, eid bigint")
