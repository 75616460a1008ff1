"""A Merkle manifest of a dataset, by Merkle traversal of aligned blocks.

Every row is a leaf. The leaves of a source, in the order of their ids, form a 16-ary tree, and the sources' roots
another. A tree is cut into aligned blocks of a fixed number of levels, each of them a row that a task takes by itself;
block roots are the leaves of the same step one block height up, and so on. On the way down each block walks its leaves
from left to right: a treehash stack a level gets the next run of nodes ready, a leaf a step, while the current run is in
use, so that authentication paths come leaf by leaf from logarithmic memory. Paths above a block are appended to its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weald.llm.common import crc32_sql, forget, table, tidy, written

#: Children of a node, and levels of a block: 4096 leaves.
ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
#: Columns whose values a leaf is hashed from, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Treehash:
    """Nodes of one level, made from leaves that come one at a time: a stack with at most a run of each level below."""

    def __init__(self, level: int):
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, digest: str) -> None:
        """Takes a leaf; a run that is full becomes its parent."""
        for run in self.runs[:-1]:
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = sha(*run)
            run.clear()
        self.runs[-1].append(digest)

    def close(self) -> list[str]:
        """The nodes of the level, after what is left of unfinished runs has become parents too."""
        for below, above in zip(self.runs, self.runs[1:], strict=False):
            if below:
                above.append(sha(*below))
                below.clear()
        out, self.runs[-1] = self.runs[-1], []
        return out


def block_root(leaves: list[str], levels: int) -> str:
    """The node `levels` above all the leaves, of which there are ARITY ** levels at most."""
    stack = Treehash(levels)
    for leaf in leaves:
        stack.add(leaf)
    return stack.close()[0]


def traversal(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in order, the digests left and right of its node at every level of a block, put together.

    Level k's run of nodes covers ARITY ** (k + 1) leaves. While they are passed, its stack takes the leaves of the next
    run one by one, so that this is ready when they end.
    """
    n = len(leaves)
    spans = [ARITY ** (k + 1) for k in range(levels)]
    stacks = [Treehash(k) for k in range(levels)]
    runs: list[list[str]] = []
    for stack, span in zip(stacks, spans, strict=True):
        for leaf in leaves[:span]:
            stack.add(leaf)
        runs.append(stack.close())
    for i in range(n):
        path = []
        for k, span in enumerate(spans):
            if i and not i % span:
                runs[k] = stacks[k].close()
            if i + span < n:
                stacks[k].add(leaves[i + span])
            run, at = runs[k], i % span * ARITY // span
            path.append(("".join(run[:at]), "".join(run[at + 1 :])))
        yield path


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf leads to along its path."""
    for left, right in path:
        digest = sha(left, digest, right)
    return digest


def encoded(column: F.Column) -> F.Column:
    """`-` for a null, else the UTF-8 bytes' number, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256))


def height(n: F.Column) -> F.Column:
    """Levels of the part of a tree of n nodes that one block holds: as many as there are until one node remains."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(n <= ARITY**k, k).otherwise(out)
    return out


def placed(nodes: DataFrame, *order) -> DataFrame:
    """Written: nodes (tree, ...) with `place`, their number in their tree in the given order, and `n`, the number of the tree's nodes.

    Rows are sorted by ranges of tree and order, so a large tree is dealt out like any other rows; what is gathered is one
    count a tree and partition.
    """
    rows = written(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("at", 33)
    counts = rows.groupBy("tree", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before, whole = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    counts = counts.select("tree", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("n"))
    out = rows.withColumn("part", part).join(counts, ["tree", "part"]).select(*nodes.columns, (F.col("at") - F.col("first") + F.col("offset")).alias("place"), "n")
    return out


def packed(nodes: DataFrame, keep: str = "") -> DataFrame:
    """(tree, block, n, levels, digests, root, kept) of nodes (tree, place, n, digest[, kept]): a row for every aligned
    block, with its leaves' digests in order, what `keep` names beside them, and its root."""
    name, kind = keep.split(" ", 1) if keep else ("kept", "boolean")
    wide = nodes.select("tree", F.floor(F.col("place") / BLOCK).alias("block"), "place", "n", height(F.col("n")).alias("levels"), "digest", F.col(name) if keep else F.lit(None).cast("boolean").alias("kept"))
    schema = f"tree string, block bigint, n bigint, levels int, digests binary, root binary, kept array<{kind}>"

    def run(of: pa.Table) -> pa.Table:
        of = of.sort_by("place")
        found = of.column("digest").to_pylist()
        first = {c: of.column(c)[0] for c in ("tree", "block", "n", "levels")}
        root = block_root([d.hex() for d in found], first["levels"].as_py())
        kept = of.column(name).combine_chunks()
        kept = kept if isinstance(kept, pa.Array) else pa.concat_arrays(kept.chunks)
        lists = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
        return pa.table({**{c: pa.array([v.as_py()], v.type) for c, v in first.items()}, "digests": [b"".join(found)], "root": [bytes.fromhex(root)], "kept": lists})

    return wide.groupBy("tree", "block").applyInArrow(run, schema)


#: Digests left and right of a node, put together, from a block's top level to the root; and what is handed down with them.
PATH = "array<struct<left: string, right: string>>"
ABOVE = f"tree string, place bigint, path {PATH}, subroot binary"


def paths_below(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """ABOVE rows for every leaf of the blocks: its path in its block, with the one above the block appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                upper, walk = row["path"], traversal(split(row["digests"]), row["levels"])
                paths = [[{"left": a, "right": b} for a, b in path] + upper for path in walk]
                found = ({"tree": row["tree"], "place": row["block"] * BLOCK + at, "path": path, "subroot": row["subroot"]} for at, path in enumerate(paths))
                yield pa.RecordBatch.from_pylist(list(found), schema=kinds)

    kinds = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.binary())])
    return joined(blocks, above).select("tree", "block", "levels", "digests", "path", "subroot").mapInArrow(tidy(run), ABOVE)


def split(digests: bytes) -> list[str]:
    return [digests[i : i + 32].hex() for i in range(0, len(digests), 32)]


def joined(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with what is above them. Keys are blocks, so none is hot; Spark broadcasts `above` where it is small."""
    return blocks.join(above.withColumnRenamed("place", "block"), ["tree", "block"])


def tree(nodes: DataFrame, keep: str = "") -> tuple[list[DataFrame], DataFrame]:
    """The written blocks of trees (tree, place, n, digest), from their leaves up, and (tree, digest) of their roots."""
    levels = [written(packed(nodes, keep), "merkle-blocks")]
    while True:
        last = levels[-1]
        up = last.select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))
        if not up.where("n > 1").limit(1).count():
            break
        levels.append(written(packed(up), "merkle-blocks"))  # trees that have ended pass with no level of their own
    return levels, up.select("tree", "digest")


def manifest(df: DataFrame, tampered: F.Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents.

    A leaf is the sha256 of doc_id, source, lang, n_chars and text, each `-` if null, else its UTF-8 byte count, a colon
    and its value. A source's leaves, by doc_id (null first; repeated ids by digest), have every 16 nodes (the last run:
    what is left) hashed into one until one remains, its subroot; subroots, by source (null first, else by bytes),
    likewise, into the root. The proof is the hash of all siblings, level by level, from left to right. folded_root is
    worked out from the leaf of the row as it is found, which is another one where `tampered` holds (there the text's A-Z
    are lower-cased), and from the siblings of the true rows; verified says whether it is the root.

    Null ids, sources and texts are values like others; repeated rows are leaves of their own; an empty table gives no
    row. Further columns are not read.
    """
    found = [F.col(f"`{c}`") for c in FIELDS]
    upper = "".join(map(chr, range(65, 91)))
    other = F.when(F.coalesce(tampered, F.lit(False)), digest(*found[:-1], F.translate(found[-1], upper, upper.lower()))) if tampered is not None else F.lit(None).cast("binary")
    name = F.coalesce(F.concat(F.lit("1"), found[1].cast("string")), F.lit("0"))
    leaves = df.select(name.alias("tree"), found[0].cast("long").alias("doc_id"), digest(*found).alias("digest"), other.alias("other"))
    leaves = written(leaves, "merkle-leaves")  # texts are read once, not again for the ranges of the order
    kind = "struct<doc_id: bigint, other: binary>"
    spots = placed(leaves, F.asc_nulls_first("doc_id"), "digest").select("tree", "place", "n", "digest", F.struct("doc_id", "other").alias("of"))
    levels, subroots = tree(spots, f"of {kind}")
    subroots = written(subroots, "merkle-subroots")
    tops, roots = tree(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "source"), "source string")
    above = df.sparkSession.createDataFrame([("", 0, [], None)], ABOVE)
    for blocks in reversed(tops):
        above = paths_below(blocks, above)  # in the end by place in the order of sources
    named = tops[0].select("block", F.posexplode("kept").alias("at", "tree")).select((F.col("block") * BLOCK + F.col("at")).alias("place"), "tree")
    above = named.join(above.select("place", "path"), "place").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    above = above.select("tree", F.lit(0).cast("long").alias("place"), "path", "subroot")
    for blocks in reversed(levels[1:]):
        above = paths_below(blocks, above)
    above = written(above, "merkle-paths")  # one row a block
    below = joined(levels[0], above).select("levels", "digests", "kept", "path", "subroot", roots.select("digest").scalar().alias("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                upper = [(x["left"], x["right"]) for x in block["path"]]
                shared = "".join(a + b for a, b in upper).encode()
                leaves, subroot, top = split(block["digests"]), block["subroot"].hex(), block["top"].hex()
                rows = []
                for leaf, row, path in zip(leaves, block["kept"], traversal(leaves, block["levels"]), strict=True):
                    proof = hashlib.sha256("".join(a + b for a, b in path).encode() + shared).hexdigest()
                    fold = folded(folded(leaf if row["other"] is None else row["other"].hex(), path), upper)
                    rows.append((row["doc_id"], leaf, subroot, top, proof, fold, fold == top))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    found = below.mapInArrow(tidy(run), "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = written(found, "merkle")
    for old in (leaves, *levels, *tops, subroots, above):
        forget(old)
    return out


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    """manifest of all documents, of which those whose id's crc32 is divisible by 5 are tampered with (never a null id)."""
    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op13_sql(source_levels: int = 6, top_levels: int = 4) -> str:
    """The manifest level by level, as far as 16 ** levels rows a source and sources."""
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(enc(c) for c in (*FIELDS[:-1], text))})"
    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    out = [f"""t AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, {leaf("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS other
  FROM documents
), s0 AS (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS m, leaf AS node, doc_id, other
  FROM t)"""]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            out.append(f"{name}r{k} AS (SELECT tree, p // 16 AS p, max(m) AS m, list(node ORDER BY p) AS run FROM {name}{k} GROUP BY tree, p // 16)")
            out.append(f"{name}{k + 1} AS (SELECT tree, p, (m + 15) // 16 AS m, CASE WHEN m > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node FROM {name}r{k})")

    def walk(name: str, runs: str, count: int, tree: str, place: str) -> None:
        for k in range(count):
            i = f"({place} // {16**k} % 16)"
            out.append(f"""{name}{k + 1} AS (
  SELECT w.* REPLACE (
    CASE WHEN r.m > 1 THEN w.proof || array_to_string(r.run[:{i}] || r.run[{i} + 2:], '') ELSE w.proof END AS proof,
    CASE WHEN r.m > 1 THEN sha256(array_to_string(r.run[:{i}] || [w.fold] || r.run[{i} + 2:], '')) ELSE w.fold END AS fold)
  FROM {name}{k} w JOIN {runs}r{k} r ON r.tree = {tree} AND r.p = {place} // {16 ** (k + 1)})""")

    levels("s", source_levels)
    out.append(f"u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS m, node, tree AS source FROM s{source_levels})")
    levels("u", top_levels)
    out.append("w0 AS (SELECT doc_id, tree, p, node AS leaf, other AS fold, '' AS proof FROM s0)")
    walk("w", "s", source_levels, "w.tree", "w.p")
    out.append(f"v0 AS (SELECT w.*, u0.p AS q, u0.node AS subroot FROM w{source_levels} w JOIN u0 ON u0.source = w.tree)")
    walk("v", "u", top_levels, "''", "w.q")
    return f"""WITH {", ".join(out)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified
FROM v{top_levels}, u{top_levels}"""
