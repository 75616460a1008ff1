"""Contraction rounds in which edges stay where they are.

Edges are dealt out once, by ranges of their ends, to parts that a bucketed table keeps together through all rounds and
splits. A round moves vertices only: each part's lightest edge at each of its vertices, the vertices' roots, and, for
every part, the new labels of those of its vertices that have one. Labels of all rounds together are one parent table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weald.functions import forest
from weald.operators import contraction as c
from weald.plans import local
from weald.plans.staging import Bucketed, Stage

#: Edges that a part holds about; a task holds one part. Vertices of any degree are split, as ranges go by both ends.
PART_EDGES = 2_000_000

ROWS = "part bigint, u bigint, v bigint, eid bigint, edge boolean"

def bucket_keys(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket the least number that falls into it, so that parts of these names have a bucket each."""
    span = 20 * buckets
    while True:
        found = spark.range(span).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket")).agg(F.min("id").alias("id")).collect()
        if len(found) == buckets:
            return [r["id"] for r in sorted(found, key=lambda r: r["bucket"])]
        span *= 2


def part_rows(part: int, u: np.ndarray, v: np.ndarray, eid: np.ndarray, reduce: bool) -> pa.RecordBatch:
    """ROWS of a part: its edges without loops and of parallel ones the lightest (with `reduce`: those of its forest), and
    for each vertex its lightest edge among them (edge false: vertex, other end, eid)."""
    keep = u != v
    u, v, eid = np.minimum(u, v)[keep], np.maximum(u, v)[keep], eid[keep]
    order = np.argsort(eid, kind="stable")
    u, v, eid = u[order], v[order], eid[order]
    names, (a, b) = forest.compact(u, v)
    keep = forest.contract(len(names), a, b)[0] if reduce else np.sort(np.unique(a * len(names) + b, return_index=True)[1])
    u, v, a, b, eid = u[keep], v[keep], a[keep], b[keep], eid[keep]
    best = forest.lightest(len(names), a, b, np.arange(len(eid)), len(eid))
    at = np.flatnonzero(best < len(eid))
    best = best[at]
    columns = [np.concatenate(x) for x in ((u, names[at]), (v, names[a[best] + b[best] - at]), (eid, eid[best]))]
    flag = np.arange(len(columns[0])) < len(eid)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(flag), part)), *map(pa.array, columns), pa.array(flag)], ["part", "u", "v", "eid", "edge"])


def stored(rows: DataFrame, buckets: int) -> Bucketed:
    """A table of ROWS that knows how many edges there are, and their least and greatest eid."""
    eid = F.when(F.col("edge"), F.col("eid"))
    return Bucketed(rows, "parts", buckets, "part", "edge", edges=F.count_if(F.col("edge")), ends=F.count_if(~F.col("edge")), low=F.min(eid), high=F.max(eid))


class Parts:
    """Edges (part, u, v, eid) and each part's lightest edges at its vertices, of a bucketed table or of a range of its eids."""

    def __init__(self, table: Bucketed, buckets: int, keys: list[int], upto: int | None = None, above: int | None = None, size: int | None = None):
        self.table, self.buckets, self.keys = table, buckets, keys
        self.upto, self.above = upto, above
        self.size = table.counts["edges"] or 0 if size is None else size
        self.low, self.high = table.counts["low"], table.counts["high"] if upto is None else upto

    def _within(self, df: DataFrame) -> DataFrame:
        df = df if self.upto is None else df.where(F.col("eid") <= self.upto)
        return df if self.above is None else df.where(F.col("eid") > self.above)

    @property
    def edges(self) -> DataFrame:
        return self._within(self.table.df.where("edge").select("part", "u", "v", "eid"))

    @property
    def ends(self) -> DataFrame:
        """(part, vertex, other, eid). Of a lower range these are the table's, as far as they are in it; there is none above."""
        found = self.table.df.where("not edge").select("part", F.col("u").alias("vertex"), F.col("v").alias("other"), "eid")
        return found if self.upto is None else found.where(F.col("eid") <= self.upto)

    def split(self, middle: int, lighter: int) -> tuple[Parts, Parts]:
        """The edges up to an eid, which number `lighter`, and the rest. Nothing is written."""
        return Parts(self.table, self.buckets, self.keys, middle, self.above, lighter), Parts(self.table, self.buckets, self.keys, self.upto, middle, self.size - lighter)

    def vertices(self) -> int:
        """About how many there are."""
        return self.ends.agg(F.approx_count_distinct("vertex", 0.02)).collect()[0][0]

    def drop(self) -> None:
        self.table.drop()


def dealt(edges: DataFrame, reduce: bool = True, size: int | None = None) -> Parts:
    """Edges (u, v, eid), dealt out by ranges of (u, v): the one exchange of edges of a run."""
    spark = edges.sparkSession
    size = edges.count() if size is None else size
    # not fewer than an exchange has by itself, or Spark would rather deal the edges out again
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_EDGES))
    keys = bucket_keys(spark, buckets)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunks, held = keys[TaskContext.get().partitionId()], local.Chunks(), []
        for batch in batches:
            one = [batch.column(n).to_numpy() for n in ("u", "v", "eid")]
            if reduce:
                chunks.add(*one)
            else:
                held.append(one)
        if reduce and chunks.held:
            yield part_rows(part, *chunks.forest(), False)
        elif held:
            yield part_rows(part, *(np.concatenate(x) for x in zip(*held, strict=True)), False)

    rows = edges.select("u", "v", "eid").repartitionByRange(buckets, "u", "v").mapInArrow(lay, ROWS)
    return Parts(stored(rows, buckets), buckets, keys)


def pushed(parts: Parts, labels: DataFrame, extra: Parts | None = None) -> DataFrame:
    """(part, vertex, root): the labels (vertex, parent) of the vertices that each part has, once for each."""
    asked = parts.ends.select("part", "vertex")
    if extra:
        asked = asked.unionByName(extra.ends.select("part", "vertex")).distinct()
    return asked.join(labels.select("vertex", F.col("parent").alias("root")), "vertex").select("part", "vertex", "root")


def moved(parts: Parts, labels: DataFrame, reduce: bool, extra: Parts | None = None) -> DataFrame:
    """ROWS of the parts after their ends have got new labels. Edges stay in their bucket; only labels (and the few edges
    of `extra`) are exchanged."""
    news = pushed(parts, labels, extra).select(F.col("part").alias("to"), F.col("vertex").alias("a"), F.col("root").alias("b"), F.lit(None).cast("bigint").alias("id"))
    if extra:
        news = news.unionByName(extra.edges.select(F.col("part").alias("to"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("eid").alias("id")))

    def run(edges: pa.Table, told: pa.Table) -> pa.Table:
        part = (edges["part"] if edges.num_rows else told["to"])[0].as_py()
        u, v, eid = (edges[n].to_numpy() for n in ("u", "v", "eid"))
        more = np.array(told["id"].is_valid())
        a, b = (told[n].to_numpy() for n in ("a", "b"))
        if more.any():
            ids = told["id"].filter(pa.array(more)).to_numpy()
            u, v, eid = (np.concatenate(x) for x in ((u, a[more]), (v, b[more]), (eid, ids)))
        a, b = a[~more], b[~more]
        order = np.argsort(a)
        a, b = a[order], b[order]

        def named(ends: np.ndarray) -> np.ndarray:
            if not len(a):
                return ends
            at = np.minimum(np.searchsorted(a, ends), len(a) - 1)
            return np.where(a[at] == ends, b[at], ends)

        return pa.Table.from_batches([part_rows(part, named(u), named(v), eid, reduce)])

    return parts.edges.groupBy("part").cogroup(news.groupBy("to")).applyInArrow(run, ROWS)


def relabelled(parts: Parts, labels: DataFrame, reduce: bool, extra: Parts | None = None) -> Parts:
    return Parts(stored(moved(parts, labels, reduce, extra), parts.buckets), parts.buckets, parts.keys)


class Parents:
    """The parent table of a run: every round's labels (vertex, parent) of the vertices that it has merged into others.

    A vertex gets a label once; roots have none. What a label stands for after later rounds is found by looking those up,
    from the last, so that each look-up is for the rows of one round.
    """

    def __init__(self) -> None:
        self.versions: list[tuple[DataFrame, list[Stage]]] = []

    def add(self, labels: DataFrame, stages: list[Stage]) -> None:
        self.versions.append((labels, stages))

    def mark(self) -> int:
        return len(self.versions)

    def since(self, mark: int) -> DataFrame | None:
        """(vertex, parent): the present roots of all vertices merged since the mark, which become one version."""
        if mark == len(self.versions):
            return None
        if mark < len(self.versions) - 1:
            known = None
            for labels, _ in reversed(self.versions[mark:]):
                if known is not None:
                    up = known.select(F.col("vertex").alias("parent"), F.col("parent").alias("root"))
                    labels = labels.join(up, "parent", "left").select("vertex", F.coalesce("root", "parent").alias("parent")).unionByName(known)
                known = labels
            whole = Stage(known, "parents")
            for _, stages in self.versions[mark:]:
                for old in stages:
                    old.drop()
            self.versions[mark:] = [(whole.df, [whole])]
        return self.versions[mark][0]

    def drop(self) -> None:
        for _, stages in self.versions:
            for old in stages:
                old.drop()
        self.versions.clear()


def one_round(parts: Parts, parents: Parents, reduce: bool, one_task: int = 0) -> tuple[Stage, DataFrame, Parts]:
    """(a table, the tree edges (eid) in it, the contracted parts): every vertex joins the neighbour at its lightest edge.

    Where the parts' vertices have no more rows than one_task, a single task finds the roots; else they are found by joins.
    """
    if (parts.table.counts["ends"] or 0) <= one_task:
        found = hooked_together(parts.ends)
        tree, labels, stages = found.df.where("kind = 'tree'").select("eid"), base_labels(found), []
    else:
        best = parts.ends.select(F.col("vertex").alias("src"), F.col("other").alias("dst"), "eid")
        found = Stage(c.hooked(c.lightest_arcs(best)), "hooks")
        stages = c.settled(found.df)
        tree, labels = c.tree_edges(found.df), c.labels_of(stages)
    parents.add(labels, stages)
    return found, tree, relabelled(parts, labels, reduce)


BASE = "kind string, a bigint, b bigint, eid bigint"


def base_rows(names: np.ndarray, label: np.ndarray, eid: np.ndarray) -> pa.RecordBatch:
    """BASE rows: 'tree' with the eids, and 'label' (a: vertex, b: root) of the vertices that aren't roots."""
    at = np.flatnonzero(label != np.arange(len(names)))
    none = np.zeros(len(eid), np.int64)
    columns = [*(np.concatenate([none, names[x]]) for x in (at, label[at])), np.concatenate([eid, np.zeros(len(at), np.int64)])]
    return pa.RecordBatch.from_arrays([pa.array(["tree"] * len(eid) + ["label"] * len(at)), *map(pa.array, columns)], ["kind", "a", "b", "eid"])


def base_labels(found: Stage) -> DataFrame:
    return found.df.where("kind = 'label'").select(F.col("a").alias("vertex"), F.col("b").alias("parent"))


def hooked_together(ends: DataFrame) -> Stage:
    """BASE rows of one round over (vertex, other, eid), in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(n).to_numpy() for n in ("vertex", "other", "eid")] for b in batches]
        if not held:
            return
        vertex, other, eid = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(eid, kind="stable")
        names, (a, b) = forest.compact(vertex[order], other[order])
        at, first = np.unique(a, return_index=True)
        parent = np.arange(len(names))
        parent[at] = b[first]
        mutual = (parent[parent] == np.arange(len(names))) & (np.arange(len(names)) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        yield base_rows(names, forest.roots_of(parent), np.unique(eid[order][first]))

    return Stage(ends.select("vertex", "other", "eid").repartition(1).mapInArrow(run, BASE), "hooks")


def finished(edges: DataFrame) -> Stage:
    """BASE rows of the forest of edges (u, v, eid) that fit one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = local.Chunks()
        for batch in batches:
            chunks.add(*(batch.column(n).to_numpy() for n in ("u", "v", "eid")))
        u, v, eid = chunks.forest()
        names, (a, b) = forest.compact(u, v)
        yield base_rows(names, forest.contract(len(names), a, b)[1], eid)

    return Stage(edges.select("u", "v", "eid").repartition(1).mapInArrow(run, BASE), "base")
