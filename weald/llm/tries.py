"""Conversation prefix tries by family-first merging.

Conversations with the same base id form a family, whose members begin with turns of the base conversation. A family's
rows are brought together (by digest, without their texts), its conversations rebuilt and its small trie built level by
level. Only trie nodes that a family has combined are shuffled for the global merge, and of these only the nodes that
several families share are aggregated again.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weald.llm.common import crc32_sql, forget, table, tidy, written

#: Ids of a family, and the number of different head lengths: a head is shorter than this.
FAMILY, HEADS = 100, 6
#: Characters of ids put into one row at most on their way to a hash, beyond one family's.
BLOB = 1 << 20
#: Rows of a batch that tasks hand back.
ROWS = 4096

ROOT = bytes(16)
NODE = "base bigint, node binary, parent binary, depth bigint, n_convs bigint, conv_id bigint, size bigint, n_ends bigint, ends string"
MERGED = "node binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, families bigint, ends string"


def head_length(conv: int) -> int:
    """How many turns a conversation takes over from its base conversation."""
    return crc32(str(conv).encode()) % HEADS


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def family_trie(base: int, levels: Iterator[tuple[int, list[tuple]]]) -> Iterator[tuple]:
    """Rows of NODE of one family, depth by depth, from its turns: (index, [(conv, digest, size)]) in rising order.

    A turn of the rebuilt conversation stands up to HEADS - 1 places before its own, so a depth is complete once HEADS
    more levels have been read. No more than these are held, whatever the conversations' lengths.
    """
    pending: dict[int, dict[int, tuple]] = {}
    live: dict[int, bytes] = {}  # the node that a conversation has reached, while it has turns left
    head: list[tuple] = []

    def turn(conv: int, depth: int) -> tuple | None:
        own = min(head_length(conv), len(head))
        return head[depth - 1] if depth <= own else pending.get(depth + head_length(conv) - own, {}).get(conv)

    def nodes(depth: int) -> Iterator[tuple]:
        if depth:
            reached: dict[bytes, list] = {}
            for conv in sorted(live):
                digest, size = turn(conv, depth)
                node = hashlib.blake2b(live[conv] + digest, digest_size=16).digest()
                reached.setdefault(node, [live[conv], size, []])[2].append(conv)
                live[conv] = node
        else:
            live.update(dict.fromkeys(pending.get(1, {}), ROOT))
            reached = {ROOT: [None, 0, sorted(live)]}
        for node, (parent, size, convs) in reached.items():
            ends = [c for c in convs if turn(c, depth + 1) is None]
            for c in ends:
                del live[c]
            yield base, node, parent, depth, len(convs), convs[0], size, len(ends), ",".join(map(str, ends))
        pending.pop(depth, None)

    depth = 0
    for index, turns in levels:
        pending[index] = {conv: (digest, size) for conv, digest, size in turns}
        if index < HEADS and base in pending[index]:
            head.append(pending[index][base])
        while depth <= index - HEADS - 1:
            yield from nodes(depth)
            depth += 1
    while live or not depth:
        yield from nodes(depth)
        depth += 1


def family_nodes(turns: DataFrame) -> DataFrame:
    """NODE rows of every family from (conv, turn, role, text): one shuffle, of digests in place of texts."""
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), F.lit(1), F.lit(16))
    rows = turns.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), "turn", "role", digest.alias("digest"), F.length("text").cast("long").alias("size"))
    own = Window.partitionBy("base", "conv").orderBy(F.asc_nulls_first("turn"), "role", "digest")  # in the partitions that the family has anyway
    ordered = rows.repartition("base").withColumn("index", F.row_number().over(own).cast("long")).sortWithinPartitions("base", "index", "conv")
    schema = arrow_schema(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for base, family in groupby(rows_of(batches), itemgetter(0)):
                levels = ((index, [x[2:] for x in level]) for index, level in groupby(family, itemgetter(1)))
                yield from family_trie(base, levels)

        yield from batched(found(), schema)

    return ordered.select("base", "index", "conv", "digest", "size").mapInArrow(tidy(run), NODE)


def subtrees(nodes: DataFrame) -> DataFrame:
    """MERGED rows: each family's share of its nodes' children, leaves and saved tokens, and the parents' conversations.

    nodes: NODE with families, all_convs, first_conv and all_ends of the merged node. A node counts in the family that
    has its smallest member. Rows come from the deepest up, so that only two depths of a family are held.
    """
    schema = arrow_schema(MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            below: dict[bytes, list[tuple]] = defaultdict(list)
            now = None
            for base, depth, node, parent, conv, size, families, all_convs, first, all_ends, ends in rows_of(batches):
                if base != now:
                    below.clear()
                    now = base
                mine = conv == first
                children, leaves, saved = 0, int(mine and all_convs == all_ends), (all_convs - 1) * size if mine else 0
                for c_mine, c_leaves, c_saved, row in below.pop(node, ()):
                    children, leaves, saved = children + c_mine, leaves + c_leaves, saved + c_saved
                    yield (*row[:3], first, *row[4:])
                row = (node, first, depth, None, all_convs, children, leaves, saved, families, ends)
                if parent is None:
                    yield row
                else:
                    below[parent].append((int(mine), leaves, saved, row))

        yield from batched(found(), schema)

    columns = ("base", "depth", "node", "parent", "conv_id", "size", "families", "all_convs", "first_conv", "all_ends", "ends")
    return nodes.repartition("base").sortWithinPartitions("base", F.desc("depth")).select(*columns).mapInArrow(tidy(run), MERGED)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, base, ends), joined in the order of base.

    A node's rows are dealt out by base and joined into long ones first, so that the task that feeds them to the hash
    (which has to see them in order) reads few, and holds one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            node, first, held, size = None, None, [], 0
            for one, base, part in rows_of(batches):
                if held and (one != node or size > BLOB):
                    yield node, first, ",".join(held)
                    held, size = [], 0
                if not held:
                    node, first = one, base
                held.append(part)
                size += len(part)
            if held:
                yield node, first, ",".join(held)

        yield from batched(found(), arrow_schema("node binary, base bigint, ends string"))

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for node, rows in groupby(rows_of(batches), itemgetter(0)):
                h = hashlib.sha256()
                for k, (_, _, part) in enumerate(rows):
                    h.update(("," * bool(k) + part).encode())
                yield node, h.hexdigest()

        yield from batched(found(), arrow_schema("node binary, ends_sha256 string"))

    parts = ends.select("node", "base", "ends").repartitionByRange("node", "base").sortWithinPartitions("node", "base")
    parts = parts.mapInArrow(tidy(joined), "node binary, base bigint, ends string")
    return parts.repartition("node").sortWithinPartitions("node", "base").select("node", "base", "ends").mapInArrow(tidy(fed), "node binary, ends_sha256 string")


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefix trie of rebuilt conversations, a row a node.

    Conversation c is rebuilt from the first h turns of conversation c - c % 100 (all if it has fewer, none if it is
    absent) and its own turns after its first h, h = crc32 of c in decimal, modulo 6. A node stands for a distinct
    sequence of (role, text), the root for the empty one. Columns: conv_id (its smallest member), depth, parent_conv_id
    (null at the root), n_convs (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (in its
    subtree: members - 1 times the code points of a node's last text), ends_sha256 (hash of the comma-joined ids of the
    members that end there, in ascending order).

    Turns are ordered by number, null first, then role, then a hash of the text. Null roles and texts count as empty ones,
    repeated rows are turns of their own. Rows without a conversation id take no part; an empty table has no node, not
    even a root. Other columns, whatever their names, are not read. Nodes are told apart by 128 bits of chained hashes.

    A long conversation is read as a stream by its task, and a node that many families share (a common first turn) is
    combined before it is shuffled.
    """
    q = lambda c: F.col(f"`{c}`")
    turns = df.where(q(conv).isNotNull()).select(q(conv).cast("long").alias("conv"), q(turn).alias("turn"), F.coalesce(q(role), F.lit("")).alias("role"), F.coalesce(q(text), F.lit("")).alias("text"))
    nodes = written(family_nodes(turns), "trie-nodes")
    ended = F.col("n_ends") > 0
    merged = nodes.groupBy("node").agg(F.count("*").alias("families"), F.sum("n_convs").alias("all_convs"), F.min("conv_id").alias("first_conv"), F.sum("n_ends").alias("all_ends"))
    shared = written(merged.where("families > 1"), "trie-shared")
    own = lambda c, other: F.coalesce(c, other).alias(c)
    known = nodes.join(shared, "node", "left").select(*nodes.columns, own("families", F.lit(1).cast("long")), own("all_convs", F.col("n_convs")), own("first_conv", F.col("conv_id")), own("all_ends", F.col("n_ends")))
    parts = written(subtrees(known), "trie-parts")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    single = parts.where("families = 1").select(*names, F.sha2(F.col("ends").cast("binary"), 256).alias("ends_sha256"))
    whole = [F.max(c).alias(c) if c in names[:4] else F.sum(c).alias(c) for c in names]
    several = parts.where("families > 1").groupBy("node").agg(*whole)
    hashes = hashed_ends(nodes.where(ended).join(shared.select("node"), "node", "left_semi"))
    several = several.join(hashes, "node", "left").select(*names, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    out = written(single.unionByName(several), "trie")
    for old in (nodes, shared, parts):
        forget(old)
    return out


def op11_trie(spark, sf_dir: str) -> DataFrame:
    """conversation_trie over all conversations; nulls, ties and repeats as there."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op11_sql() -> str:
    """The trie by plain joins: every rebuilt turn with the list of all turns up to it."""
    return f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS j
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT c, c - c % 100 AS base, {crc32_sql("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
moved AS (
  SELECT c.c, 0 AS own, t.j, t.role, t.txt FROM c JOIN t ON t.c = c.base AND t.j <= c.h
  UNION ALL SELECT c.c, 1, t.j, t.role, t.txt FROM c JOIN t ON t.c = c.c AND t.j > c.h
), path AS (
  SELECT c, row_number() OVER w AS d, list(sha256(length(role) || ':' || role || txt)) OVER w AS k, length(txt) AS size
  FROM moved WINDOW w AS (PARTITION BY c ORDER BY own, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT c, 0, [], 0 FROM c
), reached AS (SELECT c, d, sha256(array_to_string(k, ' ')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(k[1:d - 1], ' ')) END AS parent, size, max(d) OVER (PARTITION BY c) AS last FROM path),
nodes AS (
  SELECT node, min(c) AS conv_id, max(d) AS depth, max(parent) AS parent, count(*) AS n_convs, max(size) AS size,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256
  FROM reached GROUP BY node
), kids AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM reached a JOIN reached b ON a.c = b.c AND a.d <= b.d),
sums AS (
  SELECT top AS node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM below JOIN nodes n ON below.node = n.node LEFT JOIN kids k ON k.node = n.node GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node
"""
