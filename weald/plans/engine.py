"""Minimum spanning forests of edge tables.

All strategies order edges by (weight, u, v) on the original ends, under which the forest is unique; so every strategy,
level and partitioning returns the same edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weald.operators import contraction as c
from weald.operators.edges import canonical, lightest, without_loops
from weald.operators.order import Identified, balance, pivot
from weald.plans import dense, local, rounds
from weald.plans.metrics import settle, shuffled
from weald.plans.rounds import Parents, Parts
from weald.plans.staging import Stage
from weald.schema import validated

ALGORITHMS = ("boruvka", "filter_boruvka", "kruskal", "filter_kruskal", "merge")
#: Other names under which runs may ask for them.
ALIASES = {
    "hybridBoruvka": "boruvka",
    "filter_hybridBoruvka": "filter_boruvka",
    "local_gbbs": "merge",
    "local_gbbs_reimplementation": "filter_kruskal",
    "local_kruskal": "kruskal",
    "local_kruskal_seq": "kruskal",
}


@dataclass
class Config:
    """How to solve. Results do not depend on it.

    algorithm: one of ALGORITHMS. local_level: 0 nothing, 1 contraction within parts of the vertex range, 2 dropping
    what is not in its partition's forest and then level 1. base_edges: an edge table of at most so many goes to one
    task. filter_threshold: filter_boruvka recurses while there are more edges per vertex. stop_share: a split that leaves
    more than this in the lighter half isn't worth it. least_share: level 1 is left out where no more than this share of the
    edges stays within a block of vertices. leftover_edges: what a split leaves of its heavier half waits for the split
    around it, if there is one, where it has fewer edges than this: one recursion for both. dense_vertices: a larger table of
    no more vertices is finished where its edges are, by arrays over the vertices. one_task_rows: where the vertices of all
    parts are no more than this, one task finds a round's roots; else joins do. reduce_made: what is not in the forest of the
    partition in which it is made is left out before any exchange at levels 0 and 1 too, as it always is at level 2.
    """

    algorithm: str = "boruvka"
    local_level: int = 2
    base_edges: int = 4_000_000
    filter_threshold: float = 4.0
    stop_share: float = 0.85
    least_share: float = 0.1
    leftover_edges: int = 10_000
    dense_vertices: int = dense.MOST_VERTICES
    one_task_rows: int = 4_000_000
    reduce_made: bool = False


@dataclass
class Log:
    """What happened, a dict a step with its seconds and the bytes shuffled since the step before (in all, and by the executor
    that wrote most), and the tables that were written on the way."""

    steps: list[dict] = field(default_factory=list)
    tables: list[Stage | Parts | Parents] = field(default_factory=list)
    sent: dict[str, int] = field(default_factory=dict)

    def __call__(self, step: str, begun: float, **more) -> None:
        spark = SparkSession.active()
        settle(spark)
        now = shuffled(spark)
        each = [n - self.sent.get(k, 0) for k, n in now.items()]
        self.sent = now
        self.steps.append({"step": step, "seconds": round(perf_counter() - begun, 3), "shuffled_bytes": sum(each), "shuffled_bytes_most": max(each, default=0), **more})

    def keep(self, table):
        """Notes a table that the result reads."""
        self.tables.append(table)
        return table

    def drop(self) -> None:
        """Deletes the tables, once the result has been read or written."""
        for table in self.tables:
            table.drop()
        self.tables.clear()


def prepared(edges: DataFrame, reduce: bool = False) -> Identified:
    """(u, v, weight, eid) of validated, canonical edges without loops, of parallel ones the lightest. With `reduce` only what is in
    the forest of the partition in which an edge is made: before any exchange, so that a dense graph's edges are never moved."""
    clean = without_loops(canonical(validated(edges)))
    return Identified(local.reduced(clean, "weight") if reduce else lightest(clean))


def _smaller(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges (u, v, eid) between components, of parallel ones the lightest."""
    moved = c.relabelled(edges, labels, "u", "v").where("u <> v")
    return moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "eid").groupBy("u", "v").agg(F.min("eid").alias("eid"))


def _ids_by_rounds(parts: Parts, parents: Parents, config: Config, log: Log) -> DataFrame:
    """(eid) of the forest of the parts: rounds until the rest fits one task. Labels go to the parent table."""
    found = None
    while True:
        begun, size = perf_counter(), parts.size
        if size <= config.base_edges:
            base = log.keep(rounds.finished(parts.edges))
            parents.add(rounds.base_labels(base), [])
            log("base case", begun, edges=size)
            ids = base.df.where("kind = 'tree'").select("eid")
            return ids if found is None else found.unionByName(ids)
        if config.dense_vertices and parts.vertices() <= 0.9 * config.dense_vertices:  # an estimate
            ids, labels, stages = dense.dense_forest(parts.edges, config.dense_vertices)
            parents.add(labels, [])
            for stage in stages:
                log.keep(stage)
            log("dense base case", begun, edges=size, rounds=len(stages) - 1)
            return ids if found is None else found.unionByName(ids)
        hooks, tree, after = rounds.one_round(parts, parents, config.local_level == 2, config.one_task_rows)
        log.keep(hooks)
        found = tree if found is None else found.unionByName(tree)
        parts = log.keep(after)
        log("round", begun, edges=size)


def _ids_by_filter(parts: Parts, parents: Parents, config: Config, log: Log, depth: int = 0, within: bool = False) -> tuple[DataFrame, Parts | None]:
    """(eid) of the forest of the parts, and what is left over of them for the split around this one (`within`), or None:
    the lighter half first; of the heavier one only what connects its components, by the parent table.

    eid is the total order, so the split by its middle is exact under ties, and halves shrink at every level.
    """
    begun, m = perf_counter(), parts.size
    if m <= config.base_edges or m <= config.filter_threshold * parts.vertices():
        return _ids_by_rounds(parts, parents, config, log), None
    middle = pivot(parts.edges, 0.5, "eid")
    lighter, _ = balance(parts.edges, middle, "eid")
    if middle >= parts.high or lighter > config.stop_share * m:
        return _ids_by_rounds(parts, parents, config, log), None
    light, heavy = parts.split(middle, lighter)
    mark = parents.mark()
    first, left = _ids_by_filter(light, parents, config, log, depth + 1, within=True)
    small = log.keep(rounds.relabelled(heavy, parents.since(mark), config.local_level == 2, left))
    log("split", begun, edges=m, rest=small.size, depth=depth)
    if within and small.size < config.leftover_edges:
        return first, small
    more, after = _ids_by_filter(small, parents, config, log, depth + 1, within)
    return first.unionByName(more), after


def _contract_first(edges: DataFrame, parents: Parents, config: Config, log: Log) -> tuple[DataFrame, DataFrame | None]:
    """Level 1: (what is left of edges, eids already known, or None if too few edges are local)."""
    begun = perf_counter()
    parts = max(2, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = local.blocks(edges, 16 * parts)
    share = local.local_share(edges, block)
    if share < config.least_share:
        log("no local contraction", begun, local_share=round(share, 4))
        return edges, None
    found = log.keep(Stage(local.contracted_locally(edges, parts, block), "local"))
    trees = found.df.where("kind = 'tree'").select("eid")
    labels = found.df.where("kind = 'label'").select(F.col("a").alias("vertex"), F.col("b").alias("parent"))
    parents.add(labels, [])
    left = log.keep(Stage(_smaller(edges, labels), "contracted"))
    log("contract locally", begun, local_share=round(share, 4))
    return left.df, trees


def forest_ids(ranked_edges: DataFrame, config: Config, log: Log | None = None, parents: Parents | None = None) -> DataFrame:
    """(eid) of the forest of ranked edges (u, v, eid). `parents` gets the labels of all rounds of boruvka and filter_boruvka."""
    log = log or Log()
    parents = log.keep(Parents() if parents is None else parents)
    if config.algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm is one of {', '.join(ALGORITHMS)}")
    if config.local_level not in (0, 1, 2):
        raise ValueError("local_level is 0, 1 or 2")
    edges, known, size = ranked_edges.select("u", "v", "eid"), None, None
    by_parts = config.algorithm in ("boruvka", "filter_boruvka")
    if config.local_level == 2 or not by_parts:
        # edges may lie in any way, so that a partition's forest has most of them; dealt out by their ends, few
        stage = log.keep(Stage(local.reduced(local.near(edges, edges.count())), "reduced", edges=F.count("*")))
        edges, size = stage.df, stage.counts["edges"] or 0
    if config.algorithm == "merge":
        return local.merged(edges).select("eid")
    if not by_parts:
        return in_one_task(_few(edges, size, log), config.algorithm).select("eid")
    if config.local_level >= 1 and (config.local_level == 1 or size > config.base_edges):
        edges, known = _contract_first(edges, parents, config, log)
        size = size if known is None else None
    ids = _by_parts(edges, parents, config, log, size)
    return ids if known is None else ids.unionByName(known)


def _by_parts(edges: DataFrame, parents: Parents, config: Config, log: Log, size: int | None) -> DataFrame:
    """(eid) of the forest of edges: in one task if they fit it, else in rounds or splits over parts that are dealt out once."""
    begun = perf_counter()
    size = edges.count() if size is None else size
    if size <= config.base_edges:
        base = log.keep(rounds.finished(edges))
        parents.add(rounds.base_labels(base), [])
        log("base case", begun, edges=size)
        return base.df.where("kind = 'tree'").select("eid")
    if config.dense_vertices and dense.vertex_count(edges) <= 0.9 * config.dense_vertices:
        ids, labels, stages = dense.dense_forest(edges, config.dense_vertices)
        parents.add(labels, [])
        for stage in stages:
            log.keep(stage)
        log("dense base case", begun, edges=size, rounds=len(stages) - 1)
        return ids
    parts = log.keep(rounds.dealt(edges, config.local_level == 2, size))
    log("deal out", begun, edges=size, parts=parts.buckets)
    return _ids_by_filter(parts, parents, config, log)[0] if config.algorithm == "filter_boruvka" else _ids_by_rounds(parts, parents, config, log)


#: Edges that kruskal and filter_kruskal take of what the parts' forests leave: a task holds them all.
MOST_EDGES = 50_000_000
#: Edges above which parts are merged and reduced again before, by so many times as large parts.
TASK_EDGES, WIDER = 4_000_000, 8


def _few(edges: DataFrame, size: int, log: Log) -> DataFrame:
    """What the forests of ever larger parts leave of `size` written edges: at most TASK_EDGES, or else one part's forest, which has
    fewer edges than there are vertices. Where ends have no locality the first parts' forests keep most of the edges."""
    width = local.NEAR_EDGES * WIDER
    while size > TASK_EDGES:
        last = size <= width
        stage = log.keep(Stage(local.reduced(local.near(edges, size, width)), "reduced", edges=F.count("*")))
        edges, size, width = stage.df, stage.counts["edges"] or 0, width * WIDER
        if last:
            break
    return edges


def in_one_task(edges: DataFrame, how: str, most_edges: int = MOST_EDGES) -> DataFrame:
    """The forest of edges (u, v, eid) in a single task by plain or filtering Kruskal: the oracle for tables that fit one.
    More than most_edges are an error."""
    size = edges.count()
    if size > most_edges:
        raise ValueError(f"{size} edges are too many for one task; use boruvka or filter_boruvka")
    import numpy as np
    import pyarrow as pa

    from weald.functions import forest

    def run(batches):
        held = [[b.column(n).to_numpy() for n in ("u", "v", "eid")] for b in batches]
        if held:
            u, v, eid = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(eid, kind="stable")
            u, v, eid = u[order], v[order], eid[order]
            names, (a, b) = forest.compact(u, v)
            keep = (forest.kruskal if how == "kruskal" else forest.filter_kruskal)(len(names), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (u, v, eid)], ["u", "v", "eid"])

    return edges.select("u", "v", "eid").repartition(1).mapInArrow(run, "u bigint, v bigint, eid bigint")


def msf(edges: DataFrame, algorithm: str = "boruvka", local_level: int = 2, log: Log | None = None, **more) -> DataFrame:
    """The minimum spanning forest of edges (u, v, weight): its edges as given, with u < v, each once.

    Loops are ignored, of parallel edges the lightest counts, graphs may fall apart, an empty table has an empty forest.
    Further keywords: the fields of Config. The result reads tables in the shared folder; log.drop() deletes them.
    """
    config = Config(algorithm=ALIASES.get(algorithm, algorithm), local_level=local_level, **more)
    return _solved(edges, config, log or Log(), None)[0]


def _solved(edges: DataFrame, config: Config, log: Log, parents: Parents | None) -> tuple[DataFrame, DataFrame]:
    """The forest, and the prepared edges."""
    begun = perf_counter()
    log.sent = shuffled(edges.sparkSession)
    given = log.keep(prepared(edges, config.reduce_made or config.local_level == 2 or config.algorithm not in ("boruvka", "filter_boruvka")))
    log("prepare", begun, edges=given.size)
    return given.edges_of(forest_ids(given.df, config, log, parents)), given.df


def msf_with_components(edges: DataFrame, algorithm: str = "boruvka", local_level: int = 2, log: Log | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """The forest as by msf (boruvka or filter_boruvka), and (vertex, component) of all vertices, by the least vertex: what
    the parent table of the run says after its last round, without another search for components."""
    config = Config(algorithm=ALIASES.get(algorithm, algorithm), local_level=local_level, **more)
    if config.algorithm not in ("boruvka", "filter_boruvka"):
        raise ValueError("only boruvka and filter_boruvka keep a parent table")
    parents = Parents()
    forest, prepared_edges = _solved(edges, config, log or Log(), parents)
    vertices = prepared_edges.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    labels = parents.since(0)
    named = vertices.select("vertex", F.col("vertex").alias("root")) if labels is None else vertices.join(labels, "vertex", "left").select("vertex", F.coalesce("parent", "vertex").alias("root"))
    least = named.groupBy("root").agg(F.min("vertex").alias("component"))
    return forest, named.join(least, "root").select("vertex", "component")


def spanning_labels(edges: DataFrame) -> DataFrame:
    """(vertex, component) of the connected components, by the least vertex."""
    return c.components(canonical(validated(edges)).select("u", "v"))
