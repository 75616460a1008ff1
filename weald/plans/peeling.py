"""Peeling: leaves go, again and again, until every vertex that is left has two neighbours at least.

A vertex is a row with its degree and the exclusive or of its neighbours' ids, so a leaf knows its last neighbour, and a
round moves vertices only: leaves tell their neighbours, whose degrees fall. Edges are read once before and once after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.plans.staging import Stage

#: Vertices that still have edges up to which one task peels the rest.
ONE_TASK_ROWS = 4_000_000

VERTICES = "vertex bigint, degree bigint, others bigint"


def vertex_rows(edges: DataFrame) -> DataFrame:
    """VERTICES of edges (u, v) without loops and repeats."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e"))
    return ends.groupBy(F.col("e.a").alias("vertex")).agg(F.count("*").alias("degree"), F.bit_xor("e.b").alias("others"))


def peeled_round(vertices: DataFrame) -> DataFrame:
    """VERTICES after the present leaves have gone."""
    leaves = vertices.where("degree = 1").select(F.col("others").alias("at"), F.col("vertex").alias("leaf"))
    told = leaves.groupBy("at").agg(F.count("*").alias("fewer"), F.bit_xor("leaf").alias("gone"))
    left = vertices.where("degree > 1").join(told, vertices["vertex"] == told["at"], "left")
    fewer = left.select("vertex", (F.col("degree") - F.coalesce("fewer", F.lit(0))).alias("degree"), F.col("others").bitwiseXOR(F.coalesce("gone", F.lit(0))).alias("others"))
    return fewer.where("degree > 0")


def peeled_together(vertices: DataFrame) -> DataFrame:
    """VERTICES that are left at the end, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(n).to_numpy() for n in ("vertex", "degree", "others")] for b in batches]
        if not held:
            return
        names, degree, others = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(names)
        names, degree, others = names[order], degree[order].copy(), others[order].copy()
        while len(leaves := np.flatnonzero(degree == 1)):
            at = np.searchsorted(names, others[leaves])
            degree[leaves] = 0
            np.subtract.at(degree, at, 1)
            np.bitwise_xor.at(others, at, names[leaves])
            degree[leaves] = 0  # of a pair of leaves both have told each other
        keep = degree > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (names, degree, others)], ["vertex", "degree", "others"])

    return vertices.repartition(1).mapInArrow(run, VERTICES)


def two_core(edges: DataFrame, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """The edges of the 2-core of edges (u, v, ...) without loops and repeats: what is left when leaves are taken away until
    there are none. Rounds are as many as the longest branch is deep, unless the vertices fit one task. What is taken away are
    bridges, so a minimum spanning forest has all of it."""
    counts = {"rows": F.count("*"), "leaves": F.count_if(F.col("degree") == 1)}
    now = Stage(vertex_rows(edges), "vertices", **counts)
    while now.counts["leaves"]:
        together = now.counts["rows"] <= one_task_rows
        after = Stage(peeled_together(now.df) if together else peeled_round(now.df), "vertices", **counts)
        now.drop()
        now = after
    for end in ("u", "v"):
        edges = edges.join(now.df.select(F.col("vertex").alias(end)), end, "left_semi")
    return edges
