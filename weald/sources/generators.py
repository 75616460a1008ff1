"""Synthetic graphs. Every draw is a hash of a row number and the seed, so a graph is the same however it is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weald.operators.edges import lightest

#: Weights are drawn from 1 to this.
MAX_WEIGHT = 254
#: Chances of the four quadrants of a recursive matrix, in hundredths (they add up to 100).
QUADRANTS = (57, 19, 19, 5)
DISTANCES = ("random", "euclidean", "squared_euclidean")


def draw(seed: int, *of: Column | int) -> Column:
    """A long of 52 random bits: the first of the MD5 of the numbers, which any SQL engine can draw as well."""
    text = F.concat_ws("/", *(F.lit(str(x)) if isinstance(x, int) else x.cast("string") for x in (seed, *of)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *of: Column | int) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *of) / float(1 << 52)


def below(n: int, seed: int, *of: Column | int) -> Column:
    return draw(seed, *of) % n


def weighted(pairs: DataFrame, seed: int = 0, most: int = MAX_WEIGHT, kind: str = "random", square: Column | None = None, longest: float = 1.0) -> DataFrame:
    """(u, v, weight) of pairs: canonical, without loops and parallels. random: a hash of both ends, so both orientations
    agree; euclidean and squared_euclidean: the (squared) distance, `square` being its square, scaled from [0, longest] to [1, most]."""
    if kind not in DISTANCES:
        raise ValueError(f"kind is one of {', '.join(DISTANCES)}")
    u, v = F.least("u", "v"), F.greatest("u", "v")
    if kind == "random":
        weight = 1 + below(most, seed, u, v)
    else:
        share = F.sqrt(square) / longest if kind == "euclidean" else square / (longest * longest)
        weight = 1 + F.least(F.floor(share * (most - 1)), F.lit(most - 1))
    return lightest(pairs.where("u <> v").select(u.alias("u"), v.alias("v"), weight.cast("bigint").alias("weight")))


def gnm(spark: SparkSession, log_n: int, log_m: int, seed: int = 0, most: int = MAX_WEIGHT) -> DataFrame:
    """2^log_m draws of uniform pairs of 2^log_n vertices; loops and repeats fall away."""
    n = 1 << log_n
    return weighted(spark.range(1 << log_m).select(below(n, seed, F.col("id"), 1).alias("u"), below(n, seed, F.col("id"), 2).alias("v")), seed, most)


def rmat(spark: SparkSession, log_n: int, log_m: int, seed: int = 0, most: int = MAX_WEIGHT) -> DataFrame:
    """2^log_m draws of a recursive matrix over 2^log_n vertices: a quadrant a bit, power-law degrees."""
    a, b, c, _ = QUADRANTS
    u, v = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for bit in range(log_n):
        draw = below(100, seed, F.col("id"), bit)
        u = u * 2 + (draw >= a + b).cast("bigint")
        v = v * 2 + (((draw >= a) & (draw < a + b)) | (draw >= a + b + c)).cast("bigint")
    return weighted(spark.range(1 << log_m).select(u.alias("u"), v.alias("v")), seed, most)


def grid(spark: SparkSession, *sides: int, seed: int = 0, most: int = MAX_WEIGHT) -> DataFrame:
    """A periodic grid; each vertex is joined with the next one in every dimension."""
    total, stride, ends = 1, 1, []
    for s in sides:
        total *= s
    for s in sides:
        at = F.pmod(F.floor(F.col("id") / stride), F.lit(s))
        ends.append(F.col("id") + (F.when(at == s - 1, F.lit(1 - s)).otherwise(F.lit(1)) * stride).cast("bigint"))
        stride *= s
    pairs = spark.range(total).select(F.col("id").alias("u"), F.explode(F.array(*ends)).alias("v"))
    return weighted(pairs, seed, most)


def grid_2d(spark: SparkSession, log_x: int, log_y: int, **more) -> DataFrame:
    return grid(spark, 1 << log_x, 1 << log_y, **more)


def grid_3d(spark: SparkSession, log_side: int, **more) -> DataFrame:
    return grid(spark, *([1 << log_side] * 3), **more)


def rgg(spark: SparkSession, dims: int, log_n: int, radius: float, seed: int = 0, most: int = MAX_WEIGHT, kind: str = "random") -> DataFrame:
    """Random geometric graph: 2^log_n points of the unit square or cube, joined up to the radius.

    Points meet by grid cell: each is copied into the cells around its own, and an equi-join by cell finds the pairs.
    """
    cells = max(1, int(1 / radius))
    names = [f"x{i}" for i in range(dims)]
    points = spark.range(1 << log_n).select("id", *(uniform(seed, F.col("id"), i).alias(x) for i, x in enumerate(names)))
    cell = [F.least(F.floor(F.col(x) * cells), F.lit(cells - 1)).cast("int").alias(f"c{i}") for i, x in enumerate(names)]
    own = points.select("*", *cell)
    moved = own
    for i in range(dims):
        moved = moved.withColumn(f"c{i}", F.explode(F.array(*(F.col(f"c{i}") + d for d in (-1, 0, 1)))))
    other = moved.select(F.col("id").alias("v"), *(F.col(x).alias(f"y{i}") for i, x in enumerate(names)), *(f"c{i}" for i in range(dims)))
    by = [F.col(f"x{i}") - F.col(f"y{i}") for i in range(dims)]
    square = sum((d * d for d in by[1:]), by[0] * by[0])
    near = own.join(other, [f"c{i}" for i in range(dims)]).where(F.col("id") < F.col("v")).where(square <= radius * radius)
    return weighted(near.select(F.col("id").alias("u"), "v", square.alias("s")), seed, most, kind, F.col("s"), radius)


def degree_radius(dims: int, log_n: int, log_m: int) -> float:
    """The radius at which about 2^log_m edges are expected."""
    import math

    ball = math.pi if dims == 2 else 4 * math.pi / 3
    return min(1.0, ((1 << (log_m + 1)) / ((1 << log_n) * (1 << log_n) * ball)) ** (1 / dims))


def hyperbolic_shape(log_n: int, log_m: int, gamma: float) -> tuple[float, float]:
    """The growth of density outwards, and the radius of the disk."""
    import math

    n, alpha = 1 << log_n, (gamma - 1) / 2
    degree = 2 * (1 << log_m) / n
    shape = (alpha / (alpha - 0.5)) ** 2 if alpha > 0.5 else 4.0
    return alpha, 2 * math.log(n * 2 * shape / (math.pi * degree))


def rhg(spark: SparkSession, log_n: int, log_m: int, gamma: float = 3.0, seed: int = 0, most: int = MAX_WEIGHT, bands: int = 12) -> DataFrame:
    """Random hyperbolic graph: points of a disk with density rising outwards, joined within hyperbolic distance R.

    The degree distribution falls with the power gamma. R is set so that about 2^log_m edges are expected for large
    graphs. Points are cut into radius bands; for each pair of bands the greatest angle at which points can still be
    joined sets the width of angular cells, and an equi-join by cell finds the pairs.
    """
    import math

    n = 1 << log_n
    alpha, big = hyperbolic_shape(log_n, log_m, gamma)
    r = F.acosh(1 + (math.cosh(alpha * big) - 1) * uniform(seed, F.col("id"), 1)) / alpha
    points = spark.range(n).select("id", r.alias("r"), (uniform(seed, F.col("id"), 2) * 2 * math.pi).alias("t"))
    cuts = [big * i / bands for i in range(bands + 1)]
    band = F.least(F.floor(F.col("r") / (big / bands)), F.lit(bands - 1)).cast("int")
    points = points.withColumn("band", band)

    def widest(a: int, b: int) -> int:
        """Cells into which the circle may be cut for points of these bands: neighbours lie in the same or the next one."""
        x, y = cuts[a], cuts[b]
        if x + y <= big or not x or not y:
            return 1
        cosine = (math.cosh(x) * math.cosh(y) - math.cosh(big)) / (math.sinh(x) * math.sinh(y))
        angle = math.acos(max(-1.0, min(1.0, cosine)))
        return max(1, int(2 * math.pi / max(angle, 1e-9)) if angle < math.pi / 1.5 else 1)

    table = [(a, b, min(widest(a, b), 1 << 20)) for a in range(bands) for b in range(bands)]
    pairs = F.broadcast(spark.createDataFrame(table, "band int, other int, cells int"))  # bands * bands rows
    cell = F.least(F.floor(F.col("t") / (2 * math.pi) * F.col("cells")), F.col("cells") - 1).cast("int")
    left = points.join(pairs, "band").where("band <= other").select("id", "r", "t", "band", "other", cell.alias("cell"))
    near = F.when(F.col("cells") >= 3, F.array(*(F.pmod(cell + d, F.col("cells")).cast("int") for d in (-1, 0, 1)))).otherwise(F.sequence(F.lit(0), F.col("cells") - 1))
    right = points.select(F.col("id").alias("v"), F.col("r").alias("q"), F.col("t").alias("s"), F.col("band").alias("other")).join(pairs.select("band", "other", "cells"), "other").where("band <= other")
    right = right.withColumn("t", F.col("s")).select("v", "q", "s", "band", "other", F.explode(near).alias("cell"))
    joined = left.join(right, ["band", "other", "cell"]).where((F.col("band") < F.col("other")) | (F.col("id") < F.col("v")))
    turn = F.pi() - F.abs(F.pi() - F.abs(F.col("t") - F.col("s")))
    distance = F.cosh("r") * F.cosh("q") - F.sinh("r") * F.sinh("q") * F.cos(turn)
    return weighted(joined.where(distance <= math.cosh(big)).select(F.col("id").alias("u"), "v"), seed, most)


def generate(spark: SparkSession, graphtype: str, log_n: int = 8, log_m: int = 12, radius: float | None = None, gamma: float = 3.0, distance_type: str = "random", max_edge_weight: int = MAX_WEIGHT, seed: int = 0) -> DataFrame:
    """A graph by the name of its family. Sizes are those of the whole graph; of grids, log_n is a side's."""
    kind = distance_type.lower()
    name = graphtype.upper()
    if name == "GNM":
        return gnm(spark, log_n, log_m, seed, max_edge_weight)
    if name == "RMAT":
        return rmat(spark, log_n, log_m, seed, max_edge_weight)
    if name in ("RGG_2D", "RGG_3D"):
        dims = int(name[4])
        return rgg(spark, dims, log_n, radius or degree_radius(dims, log_n, log_m), seed, max_edge_weight, kind)
    if name == "RHG":
        return rhg(spark, log_n, log_m, gamma, seed, max_edge_weight)
    if name == "GRID_2D":
        return grid_2d(spark, log_n, log_n, seed=seed, most=max_edge_weight)
    if name == "GRID_3D":
        return grid_3d(spark, log_n, seed=seed, most=max_edge_weight)
    raise ValueError(f"no such family: {graphtype}")
