"""The base case of graphs with few vertices for their edges: edges stay in their partitions, vertex arrays move.

In each round every task finds the lightest edge at each component over its own edges, as an array over all vertices. The
arrays are merged as a tree, slice by slice, one task hooks the components, and the labels go back to all tasks as one
broadcast array. What moves has a bound that the number of vertices gives, whatever the number of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.functions.forest import roots_of
from weald.plans.staging import Stage

#: Vertices up to which arrays over them are broadcast (names and labels: 32 MB) and held by a task.
MOST_VERTICES = 2_000_000
#: Vertices of a row, arrays merged by one task at a time, and edges that a task looks at together.
SLICE, FAN_IN, TOGETHER = 1 << 16, 16, 1 << 20

NONE = np.iinfo(np.int64).max
ARRAYS = "part bigint, slice bigint, eids binary, others binary"
HOOKED = "kind string, a bigint, b bigint, data binary"


def vertex_count(edges: DataFrame) -> int:
    """About how many vertices there are."""
    return edges.select(F.explode(F.array("u", "v")).alias("x")).agg(F.approx_count_distinct("x", 0.02)).collect()[0][0]


def vertex_names(edges: DataFrame, most: int = MOST_VERTICES) -> np.ndarray:
    """The vertices in order. More than `most` are an error: the result is held by the driver and by every task."""
    found = edges.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    rows = found.limit(most + 1).toArrow()["x"].to_numpy()
    if len(rows) > most:
        raise ValueError(f"more than {most} vertices for arrays over all of them")
    return np.sort(rows)


def lightest_each(at: np.ndarray, other: np.ndarray, eid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of arcs, each `at` once with its lightest eid and the end there."""
    order = np.lexsort((eid, at))
    at, other, eid = at[order], other[order], eid[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, int)
    return at[first], other[first], eid[first]


def partition_minima(edges: DataFrame, names, label) -> DataFrame:
    """ARRAYS: for each partition the lightest edge at every component of the broadcast labels, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vertices, component = names.value, label.value
        best, far = np.full(len(vertices), NONE), np.zeros(len(vertices), np.int64)

        def take(held: list[list[np.ndarray]]) -> None:
            u, v, eid = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = component[np.searchsorted(vertices, u)], component[np.searchsorted(vertices, v)]
            keep = a != b
            a, b, eid = a[keep], b[keep], eid[keep]
            at, other, ids = lightest_each(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([eid, eid]))
            less = ids < best[at]
            best[at[less]], far[at[less]] = ids[less], other[less]

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(n).to_numpy() for n in ("u", "v", "eid")])
            size += batch.num_rows
            if size >= TOGETHER:
                take(held)
                held, size = [], 0
        if held:
            take(held)
        part = TaskContext.get().partitionId()
        for k, at in enumerate(range(0, len(vertices), SLICE)):
            if (best[at : at + SLICE] < NONE).any():
                row = [pa.array([part]), pa.array([k]), pa.array([best[at : at + SLICE].tobytes()], pa.binary()), pa.array([far[at : at + SLICE].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["part", "slice", "eids", "others"])

    return edges.select("u", "v", "eid").mapInArrow(run, ARRAYS)


def merged(arrays: DataFrame, parts: int) -> DataFrame:
    """One row a slice: the elementwise minima of all parts' arrays, FAN_IN of them at a time."""

    def run(rows: pa.Table) -> pa.Table:
        eids = np.stack([np.frombuffer(x, np.int64) for x in rows["eids"].to_pylist()])
        others = np.stack([np.frombuffer(x, np.int64) for x in rows["others"].to_pylist()])
        least = eids.argmin(0)
        at = np.arange(eids.shape[1])
        return pa.table({"part": rows["part"][:1], "slice": rows["slice"][:1], "eids": [eids[least, at].tobytes()], "others": [others[least, at].tobytes()]})

    while True:
        parts = -(-parts // FAN_IN)
        arrays = arrays.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "slice").applyInArrow(run, ARRAYS)
        if parts <= 1:
            return arrays


def hooked(minima: DataFrame, names, label) -> Stage:
    """HOOKED rows: 'tree' (a: an eid) of what this round adds, 'labels' (a: slice, data: its components' new labels), and, if
    it adds nothing, 'label' (a: vertex, b: parent) of all vertices that aren't roots. Takes one row a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vertices, component = names.value, label.value
        n = len(vertices)
        best, far = np.full(n, NONE), np.zeros(n, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                at = row["slice"] * SLICE
                best[at : at + SLICE], far[at : at + SLICE] = np.frombuffer(row["eids"], np.int64), np.frombuffer(row["others"], np.int64)
        asks = np.flatnonzero(best < NONE)
        kinds = ["kind", "a", "b", "data"]
        if not len(asks):
            at = np.flatnonzero(component != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(["label"] * len(at)), pa.array(vertices[at]), pa.array(vertices[component[at]]), pa.nulls(len(at), pa.binary())], kinds)
            return
        parent = np.arange(n)
        parent[asks] = far[asks]
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        now = roots_of(parent)[component]
        tree = np.unique(best[asks])
        yield pa.RecordBatch.from_arrays([pa.array(["tree"] * len(tree)), pa.array(tree), pa.nulls(len(tree), pa.int64()), pa.nulls(len(tree), pa.binary())], kinds)
        for k, at in enumerate(range(0, n, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(["labels"]), pa.array([k]), pa.nulls(1, pa.int64()), pa.array([now[at : at + SLICE].tobytes()], pa.binary())], kinds)

    return Stage(minima.select("slice", "eids", "others").repartition(1).mapInArrow(run, HOOKED), "hooked", tree=F.count_if(F.col("kind") == "tree"))


def dense_forest(edges: DataFrame, most_vertices: int = MOST_VERTICES) -> tuple[DataFrame, DataFrame, list[Stage]]:
    """(eid) of the forest of written edges (u, v, eid), (vertex, parent) of the vertices that aren't roots, and the tables
    that both read. The edges are read once a round, where they are."""
    context = edges.sparkSession.sparkContext
    vertices = vertex_names(edges, most_vertices)
    names, label = context.broadcast(vertices), context.broadcast(np.arange(len(vertices)))
    parts, stages = edges.rdd.getNumPartitions(), []
    while True:
        stages.append(hooked(merged(partition_minima(edges, names, label), parts), names, label))
        if not stages[-1].counts["tree"]:
            break
        rows = stages[-1].df.where("kind = 'labels'").orderBy("a").select("data").collect()  # 8 bytes a vertex
        label.unpersist()
        label = context.broadcast(np.concatenate([np.frombuffer(r[0], np.int64) for r in rows]))
    trees = [s.df.where("kind = 'tree'").select(F.col("a").alias("eid")) for s in stages]
    ids = trees[0]
    for more in trees[1:]:
        ids = ids.unionByName(more)
    return ids, stages[-1].df.where("kind = 'label'").select(F.col("a").alias("vertex"), F.col("b").alias("parent")), stages
