"""Nearest neighbours by a block matrix join over int8 products."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weald.llm.common import slices, table

#: Rows of a tile on either side: what one task holds of queries and of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 4096, 4096
#: Relative rounding allowed for in the bounds, far above that of double precision.
SLACK = 1e-9


def usable(vector: str):
    """Null, empty and zero vectors and those with null or non-finite components take no part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, each row's scale, and the length of what rounding left over."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).smallest_subnormal)
    steps = x / scale[:, None]
    q = np.clip(np.rint(steps), -127, 127).astype(np.int8)
    return q, scale, scale * np.sqrt(((steps - q) ** 2).sum(axis=1)) * (1 + SLACK)


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between two tiles, from their int8 products.

    |a - b| differs from the distance of the quantised vectors by the two left-over lengths at most. Products of int8
    are whole numbers, so the floating point product is exact (float32 below 2^24, else float64).
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    dot = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    with np.errstate(over="ignore"):
        na, nb = ((s * s * (q.astype(np.int32) ** 2).sum(axis=1)) for q, s in ((qa, sa), (qb, sb)))
    with np.errstate(over="ignore", invalid="ignore"):
        both = na[:, None] + nb[None, :]
        square = both - 2 * sa[:, None] * sb[None, :] * dot
        left = (ea[:, None] + eb[None, :]) * (1 + SLACK)
        low = np.sqrt(np.maximum(square - SLACK * both, 0)) * (1 - SLACK) - left
        high = np.sqrt(np.maximum(square + SLACK * both, 0)) * (1 + SLACK) + left
    unknown = ~(np.isfinite(low) & np.isfinite(high))  # squares beyond the range of doubles
    low[unknown], high[unknown] = -np.inf, np.inf
    return low, high


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs in double precision, components summed in order."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


def tile(qid: np.ndarray, q: tuple, cid: np.ndarray, c: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a query, row of a candidate, lower and upper bound) of all pairs that may be among a query's k nearest in
    the tile; never of the query's own id. q, c: quantised rows."""
    low, high = bounds(q, c)
    own = qid[:, None] == cid[None, :]
    high[own] = np.inf
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(qid), np.inf)
    rows, columns = np.nonzero((low <= limit[:, None]) & ~own)
    return rows, columns, low[rows, columns], high[rows, columns]


def search(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of every row for which `is_query` holds, by exact distance.

    Rows without an id and unusable vectors take no part; vectors are compared with those of their own dimension only.
    Rows that share the query's id count as its own. If several query rows share an id, the least vector is asked for;
    candidates that repeat are listed as often as they occur. Fewer than k candidates: all of them.

    Vectors are quantised once; what meets in tiles are int8 components with their scale and error. Every query block
    meets every candidate block once: candidates are copied once per query block and queries once per candidate block,
    a byte a component, so each task's memory is a tile. A pair survives its tile if its lower bound is within the k-th
    upper bound there, and then the same over all tiles. Only survivors fetch their original vectors, by a join, and
    exact distances are merged by heaps over sorted streams.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable("v"))
    rows = rows.withColumn("key", F.xxhash64("v"))
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).withColumn("key", F.xxhash64("v"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()[0]
    q_blocks, c_blocks = -(-max(counts["q"], 1) // QUERY_ROWS), -(-max(counts["n"], 1) // CANDIDATE_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sizes = np.array(pc.list_value_length(batch.column(2)))
                for dim in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == dim))
                    q, scale, left = quantise(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim))
                    columns = [part.column(0), part.column(1), pa.array([int(dim)] * part.num_rows, pa.int32()), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(left)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "key", "dim", "q", "scale", "err"])

    quantised = lambda t: t.select("id", "key", "v").mapInArrow(small, "id bigint, key bigint, dim int, q binary, scale double, err double")
    left = quantised(queries).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("cb", every(c_blocks))
    right = quantised(rows).withColumn("cb", F.pmod(F.xxhash64("id", "key"), F.lit(c_blocks)).cast("int")).withColumn("qb", every(q_blocks))

    def block(t: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple]:
        q = np.frombuffer(b"".join(t["q"].to_pylist()), np.int8).reshape(t.num_rows, -1)
        return t["id"].to_numpy(), t["key"].to_numpy(), (q, t["scale"].to_numpy(), t["err"].to_numpy())

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64),) * 3 + (np.empty(0),) * 2]
        if a.num_rows and b.num_rows:
            (qid, _, q), (cid, key, c) = block(a), block(b)
            for at in range(0, len(cid), CANDIDATE_ROWS):
                cs = slice(at, at + CANDIDATE_ROWS)
                for to in range(0, len(qid), QUERY_ROWS // 8):
                    qs = slice(to, to + QUERY_ROWS // 8)
                    r, s, low, high = tile(qid[qs], tuple(x[qs] for x in q), cid[cs], tuple(x[cs] for x in c), k)
                    found.append((qid[qs][r], cid[cs][s], key[cs][s], low, high))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], names=["query_id", "id", "key", "low", "high"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sizes = np.array(pc.list_value_length(batch.column(2)))
                for dim in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == dim))
                    a, b = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim) for i in (2, 3))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(exact(a, b))], ["query_id", "id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query: one heap of k at a time."""
        query, heap = None, []

        def done() -> pa.RecordBatch:
            best = sorted((-d, -i) for d, i in heap)
            n = len(best)
            return pa.RecordBatch.from_arrays([pa.array([query] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([i for _, i in best], pa.int64()), pa.array([d for d, _ in best], pa.float64())], ["query_id", "rank", "id", "score"])

        for batch in batches:
            for q, i, d in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if q != query:
                    if heap:
                        yield done()
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -i))
                else:
                    heapq.heappushpop(heap, (-d, -i))
        if heap:
            yield done()

    keys = ["qb", "cb", "dim"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, "query_id bigint, id bigint, key bigint, low double, high double")
    so_far = Window.partitionBy("query_id").orderBy("high", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # null before the k-th: those stay
    near = tiles.withColumn("limit", F.nth_value("high", k).over(so_far)).where("coalesce(low <= limit, true)").select("query_id", "id", "key").distinct()
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("w"))
    pairs = near.join(rows.select("id", "key", "v"), ["id", "key"]).join(asked, "query_id").select("query_id", "id", "w", "v")
    merged = pairs.mapInArrow(measure, "query_id bigint, id bigint, score double").repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id bigint, rank int, id bigint, score double")
    return merged.select(F.col("query_id").cast(id_type).alias("query_id"), "rank", F.col("id").cast(id_type).alias(id_col), "score")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every embedding whose vec_id is divisible by 100; unusable vectors, ties and repeats as in search."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_sql() -> str:
    return """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
