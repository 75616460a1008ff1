"""Projections, filters and set operations over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weald.plans.staging import Stage


def canonical(edges: DataFrame) -> DataFrame:
    """Each edge with its lesser end as u. Loops stay."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *rest)


def flip(edges: DataFrame) -> DataFrame:
    """Ends swapped."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest)


def to_arcs(edges: DataFrame) -> DataFrame:
    """Both orientations as (src, dst, ...); one pass over the input, nothing is read twice."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select(F.explode(ends).alias("a"), *rest).select("a.src", "a.dst", *rest)


def one_orientation(arcs: DataFrame, up: bool = True) -> DataFrame:
    """Arcs that lead to a greater (or lesser) end."""
    return arcs.where("src < dst" if up else "src > dst")


def without_loops(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    return edges.where(F.col(a) != F.col(b))


def lightest(edges: DataFrame) -> DataFrame:
    """One edge for each pair of ends, the lightest: a hash aggregate with partial sums before its shuffle."""
    return edges.groupBy("u", "v").agg(F.min("weight").alias("weight"))


#: Light pairs of ends that are broadcast at most: 16 bytes each and what a hash table adds.
LIGHT_KEYS = 1_000_000


def lightest_of_many(edges: DataFrame, most_keys: int = LIGHT_KEYS, share: float = 0.25) -> DataFrame:
    """lightest() of a multigraph in which most edges have lighter parallels, with fewer rows in its shuffle.

    A low quantile of the weights is the pivot: at most `share` of the edges, and as few as have most_keys pairs of ends. The
    light edges are settled first. Their pairs, whose number is checked, are broadcast, and heavier edges of the same ends
    drop out where they are. Only the rest of the heavy ones is shuffled. If ties at the pivot make too many pairs, or the
    sample says that hardly any edge has a parallel, nothing is gained and lightest() is taken.
    """
    total, keys = edges.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("u", "v"), 0.05)).collect()[0]
    if keys > 0.8 * total:
        return lightest(edges)
    at = edges.agg(F.percentile_approx("weight", min(share, most_keys / max(total, 1)), 10_000)).collect()[0][0]
    light, heavy = light_and_heavy(edges, at)
    settled = Stage(lightest(light), "light", pairs=F.count("*"))
    if settled.counts["pairs"] > most_keys:
        settled.drop()
        return lightest(edges)
    known = F.broadcast(settled.df.select("u", "v"))  # most_keys rows at most
    return settled.df.unionByName(lightest(heavy.join(known, ["u", "v"], "left_anti")))


def light_and_heavy(edges: DataFrame, pivot: int, by: str = "weight") -> tuple[DataFrame, DataFrame]:
    """Edges up to the pivot, and those above it."""
    return edges.where(F.col(by) <= pivot), edges.where(F.col(by) > pivot)


def local_edges(edges: DataFrame, part: Column, other: Column) -> DataFrame:
    """Edges whose ends lie in one part; part and other are the parts of u and v."""
    return edges.where(part == other)


def pack(high: Column, low: Column, bits: int) -> Column:
    """Two numbers in one long: high above `bits` bits of low. Orders like the pair."""
    return F.shiftleft(high.cast("bigint"), bits).bitwiseOR(low.cast("bigint"))


def unpack(packed: Column, bits: int) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, bits), packed.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Edges (canonical, with multiplicity) of one table only, with side 'actual' or 'expected'; one shuffle."""
    sides = union(*(canonical(d).select("u", "v", "weight", F.lit(n).alias("n")) for d, n in ((actual, 1), (expected, -1))))
    counted = sides.groupBy("u", "v", "weight").agg(F.sum("n").cast("bigint").alias("n")).where("n <> 0")
    return counted.select("u", "v", "weight", F.when(F.col("n") > 0, "actual").otherwise("expected").alias("side"), F.abs("n").alias("copies"))


def duplicates(edges: DataFrame) -> DataFrame:
    """Edges that occur more than once, whatever their orientation."""
    return canonical(edges).groupBy("u", "v").agg(F.count("*").alias("copies")).where("copies > 1")


def within(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """edges that are in keep, by their ends."""
    return edges.join(keep.select("u", "v"), ["u", "v"], "left_semi")


def outside(edges: DataFrame, drop: DataFrame) -> DataFrame:
    """edges that are not in drop, by their ends."""
    return edges.join(drop.select("u", "v"), ["u", "v"], "left_anti")


def missing_back_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs without a reverse arc of equal weight; empty for a symmetric table."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return arcs.join(back, ["src", "dst", "weight"], "left_anti")
