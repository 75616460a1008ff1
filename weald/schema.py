"""The edge schema and what is accepted as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Undirected edges, one row each: u < v, weight >= 1. Arcs are the symmetric form (src, dst, weight).
EDGE = "u bigint, v bigint, weight bigint"
ARC = "src bigint, dst bigint, weight bigint"
#: Identifiers stay below this, so that doubled or packed ones still fit a signed long.
MAX_ID = 1 << 62


def validated(edges: DataFrame, low: int = 0) -> DataFrame:
    """edges as (u, v, weight) longs. A null, an identifier outside [0, 2^62) or a weight below `low` raises when the row is read.

    The check is a projection inside the scan's stage: no job of its own, and nothing is silently dropped.
    """
    missing = {"u", "v", "weight"} - set(edges.columns)
    if missing:
        raise ValueError(f"edges lack columns {sorted(missing)}")
    u, v, w = (F.col(c).cast("bigint") for c in ("u", "v", "weight"))
    fine = u.isNotNull() & v.isNotNull() & w.isNotNull() & u.between(0, MAX_ID - 1) & v.between(0, MAX_ID - 1) & (w >= low)
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.to_json(F.struct(u.alias("u"), v.alias("v"), w.alias("weight"))))).cast("bigint")
    return edges.select(F.when(fine, u).otherwise(bad).alias("u"), v.alias("v"), w.alias("weight"))
