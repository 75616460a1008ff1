"""The steps of a contraction round. Edges carry (src, dst, eid) with eid in the total order, both orientations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.operators.edges import lightest
from weald.plans.staging import Stage


def lightest_arcs(arcs: DataFrame) -> DataFrame:
    """(src, eid, dst): each vertex's lightest arc. Keys are longs, so this is a hash aggregate, partial before the shuffle."""
    return arcs.groupBy("src").agg(F.min("eid").alias("eid"), F.min_by("dst", "eid").alias("dst"))


def lightest_edge_per_vertex(edges: DataFrame) -> DataFrame:
    """(vertex, weight, u, v): the lightest edge at each vertex in the total order, from edges stored once.

    First by vertex and weight, then by vertex, so that both are hash aggregates over longs, with partial results: of structs
    the least is found by sorting all ends. Of edges of one weight the least u comes first, and if that is the vertex, the least v.
    """
    ends = edges.select(F.explode(F.array("u", "v")).alias("vertex"), "u", "v", "weight")
    each = ends.groupBy("vertex", "weight").agg(F.min("u").alias("u"), F.min(F.when(F.col("u") == F.col("vertex"), F.col("v"))).alias("far"))
    each = each.select("vertex", "weight", "u", F.when(F.col("u") == F.col("vertex"), F.col("far")).otherwise(F.col("vertex")).alias("v"))
    return each.groupBy("vertex").agg(F.min("weight").alias("weight"), F.min_by("u", "weight").alias("u"), F.min_by("v", "weight").alias("v"))


def up_to_lightest(edges: DataFrame) -> DataFrame:
    """Edges (u, v, weight; parallels allowed), of parallel ones the lightest, up to the weight within which every vertex has its
    lightest edge. That is the beginning of the total order, so these edges have the numbers that they have among all, and only
    they are exchanged and sorted. A vertex with heavy edges only makes it longer, up to the whole.
    """
    least = edges.select(F.explode(F.array("u", "v")).alias("vertex"), "weight").groupBy("vertex").agg(F.min("weight").alias("weight"))
    top = least.agg(F.max("weight")).collect()[0][0]
    return lightest(edges.where(F.col("weight") <= F.lit(top)))


def hooked(best: DataFrame) -> DataFrame:
    """(vertex, parent, eid, is_root): each vertex hooks to its lightest neighbour; of two that chose each other the lesser is the root.

    Under a total order both ends of a mutual choice chose the same edge, and no longer cycle can arise. So choices are grouped
    by edge, one or two rows each: a join by the chosen neighbour would bring all that chose a hub to one task.
    """
    chosen = best.groupBy("eid").agg(F.count("*").alias("n"), F.min("src").alias("a"), F.max("src").alias("b"), F.min("dst").alias("to"))
    hook = lambda vertex, parent, root: F.struct(F.col(vertex).alias("vertex"), F.col(parent).alias("parent"), F.lit(root).alias("is_root"))
    hooks = F.when(F.col("n") == 2, F.array(hook("a", "a", True), hook("b", "a", False))).otherwise(F.array(hook("a", "to", False)))
    return chosen.select(F.explode(hooks).alias("h"), "eid").select("h.vertex", "h.parent", "eid", "h.is_root")


def tree_edges(hooks: DataFrame) -> DataFrame:
    """(eid): what the vertices that are no roots add to the forest; each edge comes from one of them only."""
    return hooks.where(~F.col("is_root")).select("eid")


def jumped(parents: DataFrame) -> DataFrame:
    """(vertex, parent): one pointer-jumping step, every parent replaced by its own."""
    up = parents.select(F.col("vertex").alias("parent"), F.col("parent").alias("grand"))
    return parents.select("vertex", "parent").join(up, "parent", "left").select("vertex", F.coalesce("grand", "parent").alias("parent"))


def settled(parents: DataFrame) -> list[Stage]:
    """Pointer jumping over written (vertex, parent), in which roots are their own parents: tables (vertex, parent, done) in
    whose `done` rows every vertex but the roots stands once, with its root.

    Each step looks up the parents of the rows that don't know their root yet, and writes these rows only; the others stay
    where they are. Steps are logarithmic in the depth.
    """
    roots = parents.where("vertex = parent").select("parent", F.lit(True).alias("root"))
    first = parents.where("vertex <> parent").select("vertex", "parent").join(roots, "parent", "left").select("vertex", "parent", F.col("root").isNotNull().alias("done"))
    left = F.count_if(~F.col("done"))
    stages = [Stage(first, "parents", left=left)]
    while stages[-1].counts["left"]:
        known = stages[-1].df
        for older in stages[:-1]:
            known = known.unionByName(older.df.where("done"))
        up = known.select(F.col("vertex").alias("at"), F.col("parent").alias("grand"), F.col("done").alias("there"))
        asks = stages[-1].df.where("not done")
        step = asks.join(up, asks["parent"] == up["at"]).select("vertex", F.col("grand").alias("parent"), F.col("there").alias("done"))
        stages.append(Stage(step, "parents", left=left))
    return stages


def labels_of(stages: list[Stage]) -> DataFrame:
    """(vertex, parent) of settled() tables."""
    out = stages[0].df.where("done").select("vertex", "parent")
    for more in stages[1:]:
        out = out.unionByName(more.df.where("done").select("vertex", "parent"))
    return out


def to_roots(parents: DataFrame) -> Stage:
    """(vertex, parent): pointer jumping until every parent is a root, roots included."""
    given = Stage(parents.select("vertex", "parent"), "parents")
    stages = settled(given.df)
    out = Stage(labels_of(stages).unionByName(given.df.where("vertex = parent")), "parents")
    for old in (given, *stages):
        old.drop()
    return out


def relabelled(arcs: DataFrame, labels: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Both ends of every arc replaced by their labels (vertex, parent); unlabelled ends stay."""
    rest = [c for c in arcs.columns if c not in (a, b)]
    for c in (a, b):
        name = labels.select(F.col("vertex").alias(c), F.col("parent").alias("_new"))
        arcs = arcs.join(name, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return arcs.select(a, b, *rest)


def contracted(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """Arcs between different components, of parallel ones the lightest."""
    return relabelled(arcs, labels).where("src <> dst").groupBy("src", "dst").agg(F.min("eid").alias("eid"))


def by_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The original edges of the ids: a semi-join, so results carry original ends and weights."""
    return edges.join(ids.select("eid"), "eid", "left_semi")


def updated(values: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """values with those of changes in their place; keys of changes are unique, new ones are added."""
    new = changes.select(key, F.col(value).alias("_new"))
    return values.join(new, key, "full").select(key, F.coalesce("_new", value).alias(value))


def components(edges: DataFrame, base_edges: int = 4_000_000) -> DataFrame:
    """(vertex, component): connected components by the least vertex. A loop makes its vertex known.

    Edges are first dealt out by ranges of their ends and reduced to a forest of each part, which has the same components. If
    at most base_edges are left they are labelled in one task; else in rounds of hooking to the least neighbour. Every round
    halves the vertices at least where edges remain; lineage is cut in the shared folder.
    """
    if base_edges:
        from weald.plans import local

        given = Stage(edges.select("u", "v"), "given", edges=F.count("*"))
        loops = given.df.where("u = v").distinct()
        near = local.near(given.df.withColumn("eid", F.monotonically_increasing_id()), given.counts["edges"] or 0)
        kept = Stage(local.reduced(near).select("u", "v").unionByName(loops), "reduced", edges=F.count("*"))
        given.drop()
        if (kept.counts["edges"] or 0) <= base_edges:
            return local.labelled(kept.df)
        edges = kept.df
    first = Stage(edges.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("a")).select("a.*").distinct(), "arcs")
    labels = Stage(first.df.select(F.col("src").alias("vertex"), F.col("src").alias("parent")).distinct(), "labels")
    arcs = Stage(first.df.where("src <> dst"), "arcs")
    while arcs.df.limit(1).count():
        # hooking to the least neighbour below, else to the least above that has none below, leaves no cycle
        low = arcs.df.groupBy("src").agg(F.min("dst").alias("dst")).select(F.col("src").alias("vertex"), F.least("src", "dst").alias("parent"))
        roots = to_roots(low)
        lonely = roots.df.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select(F.col("parent").alias("src"))
        # a vertex below all its neighbours that nothing hooked to joins one of theirs
        extra = arcs.df.join(lonely, "src", "left_semi").groupBy("src").agg(F.min("dst").alias("dst"))
        joins = extra.join(roots.df.select(F.col("vertex").alias("dst"), F.col("parent").alias("to")), "dst").select(F.col("src").alias("vertex"), F.col("to").alias("parent"))
        settled = Stage(updated(roots.df, joins, "vertex", "parent"), "parents")
        round_ = to_roots(settled.df)
        after = Stage(relabelled(arcs.df, round_.df).where("src <> dst").distinct(), "arcs")
        name = round_.df.select(F.col("vertex").alias("parent"), F.col("parent").alias("_new"))
        relabel = Stage(labels.df.join(name, "parent", "left").select("vertex", F.coalesce("_new", "parent").alias("parent")), "labels")
        for old in (arcs, labels, roots, settled, round_):
            old.drop()
        arcs, labels = after, relabel
    least = labels.df.groupBy("parent").agg(F.min("vertex").alias("component"))
    return labels.df.join(least, "parent").select("vertex", "component")
