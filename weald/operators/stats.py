"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, degree)."""
    return edges.select(F.explode(F.array("u", "v")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """(bucket, vertices): vertices by the whole binary logarithm of their degree; every vertex counts."""
    bucket = (F.length(F.bin("degree")) - 1).cast("int")
    return degrees(edges).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("vertices"))


def leaves(edges: DataFrame) -> DataFrame:
    """Edges at a vertex of degree one: all of them are in the forest. One shuffle of the ends, then a semi-join."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("vertex"), "u", "v", "weight")
    alone = ends.groupBy("vertex").agg(F.count("*").alias("n"), F.first(F.struct("u", "v", "weight")).alias("e")).where("n = 1")
    return alone.select("e.*").distinct()


def weight_sum(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("weight"), F.count("*").alias("edges"))


def totals(edges: DataFrame) -> DataFrame:
    """One row: edges, weight sum, least and greatest weight, greatest id, span of ids."""
    return edges.agg(
        F.count("*").alias("edges"), F.sum("weight").cast("bigint").alias("weight"), F.min("weight").alias("least"), F.max("weight").alias("greatest"),
        F.max(F.greatest("u", "v")).alias("max_id"), (F.max(F.greatest("u", "v")) - F.min(F.least("u", "v")) + 1).alias("id_span"),
    )


def local_share(edges: DataFrame, part, border=None) -> DataFrame:
    """One row: edges, those with both ends in a part, and those that touch no border vertex besides. part, border: functions of an end."""
    inside = part(F.col("u")) == part(F.col("v"))
    free = inside if border is None else inside & ~border(F.col("u")) & ~border(F.col("v"))
    return edges.agg(F.count("*").alias("edges"), F.count_if(inside).alias("local"), F.count_if(free).alias("truly_local"))


def lightest_cut_edge(edges: DataFrame, part) -> DataFrame:
    """(vertex, weight): the least weight of each vertex's edges to other parts."""
    far = edges.where(part(F.col("u")) != part(F.col("v"))).select(F.explode(F.array("u", "v")).alias("vertex"), "weight")
    return far.groupBy("vertex").agg(F.min("weight").alias("weight"))


def folded(minima: DataFrame, labels: DataFrame) -> DataFrame:
    """(vertex, weight): minima of the vertices' labels (vertex, parent)."""
    return minima.join(labels, "vertex").groupBy(F.col("parent").alias("vertex")).agg(F.min("weight").alias("weight"))


def below_a_cut(edges: DataFrame, part) -> DataFrame:
    """Local edges that are not heavier than both ends' lightest cut edges; an end without cut edges lets all pass."""
    cut = lightest_cut_edge(edges, part)
    inside = edges.where(part(F.col("u")) == part(F.col("v")))
    a, b = cut.select(F.col("vertex").alias("u"), F.col("weight").alias("cu")), cut.select(F.col("vertex").alias("v"), F.col("weight").alias("cv"))
    joined = inside.join(a, "u", "left").join(b, "v", "left")
    return joined.where("cu IS NULL OR cv IS NULL OR weight <= cu OR weight <= cv").select("u", "v", "weight")


def component_sizes(labels: DataFrame, forest: DataFrame) -> DataFrame:
    """(component, vertices, edges, weight) of labels (vertex, component) and their forest."""
    own = forest.join(labels.select(F.col("vertex").alias("u"), "component"), "u").groupBy("component").agg(F.count("*").alias("edges"), F.sum("weight").cast("bigint").alias("weight"))
    return labels.groupBy("component").agg(F.count("*").alias("vertices")).join(own, "component", "left").select("component", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("weight", F.lit(0)).alias("weight"))


def roots_with_edges(parents: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: roots of parents (vertex, parent) that had an edge at first."""
    touched = edges.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    return parents.where("vertex = parent").join(touched, "vertex", "left_semi").agg(F.count("*").alias("components"))


def summaries(points: DataFrame, key: str, value: str) -> DataFrame:
    """Measured points by key: sum, greatest, greatest less least, and all of them in order."""
    v: Column = F.col(value)
    return points.groupBy(key).agg(F.sum(v).alias("total"), F.max(v).alias("most"), (F.max(v) - F.min(v)).alias("spread"), F.array_sort(F.collect_list(v)).alias("each"))


def quantiles(edges: DataFrame, *shares: float) -> DataFrame:
    """One row a share: the exact weight quantile, interpolated."""
    out = edges.agg(F.percentile("weight", list(shares)).alias("q"))
    return out.select(F.posexplode("q").alias("n", "weight")).select(F.element_at(F.array(*(F.lit(float(s)) for s in shares)), F.col("n") + 1).alias("share"), "weight")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """One row: rows, distinct keys, and whether they are as many."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys")).select("rows", "keys", (F.col("rows") == F.col("keys")).alias("is_unique"))
