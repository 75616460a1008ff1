"""Is it a minimum spanning forest of these edges?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.operators.contraction import components
from weald.operators.edges import canonical, difference, duplicates, lightest, without_loops
from weald.plans.engine import msf


@dataclass
class Report:
    """Counts that are all zero for a right answer; weight is what is missing or too much."""

    foreign: int  # edges that the graph does not have
    repeated: int  # edges given more than once
    size: int  # edges too many or too few for an acyclic spanning set
    apart: int  # vertices in another component than in the graph
    weight: int

    @property
    def fine(self) -> bool:
        return not (self.foreign or self.repeated or self.size or self.apart or self.weight)


def check(edges: DataFrame, forest: DataFrame, **how) -> Report:
    """Compares a claimed forest with the graph and with the forest by another algorithm (`how`: keywords of msf).

    Sets of equal weights may differ from ours, so weight and structure are judged, not identity.
    """
    graph = lightest(without_loops(canonical(edges.select("u", "v", "weight"))))
    foreign = canonical(forest.select("u", "v", "weight")).join(graph, ["u", "v", "weight"], "left_anti").count()
    labels, own = components(graph), components(forest)
    joined = labels.join(own.withColumnRenamed("component", "other"), "vertex", "left")
    apart, vertices, parts = joined.agg(F.count_if(F.coalesce("other", F.lit(-1)) != F.col("component")), F.count("*"), F.count_distinct("component")).collect()[0]
    size, weight = forest.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).collect()[0]
    right = msf(edges, **({"algorithm": "merge"} | how)).agg(F.coalesce(F.sum("weight"), F.lit(0))).collect()[0][0]
    return Report(foreign, duplicates(forest).count(), size - (vertices - parts), apart, weight - right)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge tables hold the same edges, whatever their orientation."""
    return not difference(a, b).limit(1).count()
