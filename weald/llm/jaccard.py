"""N-gram Jaccard join with Bayesian candidate pruning.

Texts whose sets of word shingles are equal form a class. MinHash sketches of the classes fall into banded buckets;
pairs in a bucket compare their MinHash values in steps, and a pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls below a tolerance. What survives connects classes into small families;
within a family all pairs are compared in steps again and the survivors verified exactly on their shingle sets.
No stage emits pairs: buckets and families return a link to the root per member, and sums of links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.llm.common import forget, give_back, named, positional, scanned, slices, table, tidy, written
from weald.llm.components import components
from weald.llm.licenses import FOLD

#: Words of a shingle and least similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: MinHash values of a sketch, how many are compared at a step, and the posterior below which a pair is dropped.
HASHES, STEP, TOLERANCE = 128, 16, 1e-4
#: Bands of so many values: a pair of similarity 0.8 shares none with probability 2.5e-5, one of 0.85 with 4e-7.
BANDS, BAND_VALUES = 20, 4
#: Word hashes that a task remembers, at most; then it starts anew.
WORD_HASHES = 250_000
#: Members of a tile side, and shingles of all of them. Larger buckets and families are dealt out as tiles of two blocks.
TILE, TILE_GRAMS = 512, 1_000_000
#: Prefilter slots: the broadcast table that thins out texts before the join has at most so many rows.
SLOTS = 1 << 18

_A = (np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 31, HASHES, dtype=np.uint32) << 1 | 1).astype(np.uint32)
_B = np.random.Generator(np.random.PCG64(21)).integers(0, 1 << 32, HASHES, dtype=np.uint32)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: _Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles; of a shorter text: of all its words together."""
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a non-empty set, unsigned 32-bit."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        best = np.minimum(best, (x[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return best


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After 1, 2, ... steps: the least number of equal values with which P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is a Beta distribution, and its tail a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = lambda m, n=n: 1 - sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1, n + 2))
        out.append(next((m for m in range(n + 1) if tail(m) >= tolerance), n + 1))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (a[left], b[right]) of 16-bit sketches are not dropped at any step."""
    alive = np.arange(len(left))
    same = np.zeros(len(left), np.int32)
    for step, least in enumerate(least_matches(threshold)):
        at = slice(step * STEP, (step + 1) * STEP)
        same = same + (a[left[alive], at] == b[right[alive], at]).sum(axis=1, dtype=np.int32)
        keep = same >= least
        alive, same = alive[keep], same[keep]
    return alive


def common_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets (sorted, distinct) of each pair: by matrix product where many pairs share few sets, else by merging."""
    if not len(pairs):
        return np.zeros(0, np.int64)
    used = np.unique(pairs)
    lengths = np.array([len(sets[i]) for i in used])
    merge = sum(len(sets[i]) + len(sets[j]) for i, j in pairs) * 2e-8 + len(pairs) * 1e-5
    columns, inverse = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    if len(used) ** 2 * len(columns) / 1e10 < merge:
        rows = np.repeat(np.arange(len(used)), lengths)
        order = np.argsort(inverse, kind="stable")
        rows, inverse = rows[order], inverse[order]
        counts = np.zeros((len(used), len(used)), np.float32)
        width = max(1, (4 << 20) // len(used))
        for at in range(0, len(columns), width):
            lo, hi = np.searchsorted(inverse, [at, at + width])
            m = np.zeros((len(used), min(width, len(columns) - at)), np.float32)
            m[rows[lo:hi], inverse[lo:hi] - at] = 1
            counts += m @ m.T
        where = np.searchsorted(used, pairs)
        return counts[where[:, 0], where[:, 1]].astype(np.int64)
    return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])


class Roots:
    """Union-find over 0..n-1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, k, n, bands, sketch) per row: k names the class (a hash of the whole shingle set), null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch, 2):
                if len(hashes) > WORD_HASHES:
                    hashes.clear()
                keys, sizes, bands, sketches = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text, hashes)
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None)
                        bands.append(None)
                        sketches.append(None)
                        continue
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    values = sketch(s)
                    own = [hashlib.blake2b(bytes([i]) + values[i * BAND_VALUES : (i + 1) * BAND_VALUES].tobytes(), digest_size=8).digest() for i in range(BANDS)]
                    bands.append(np.frombuffer(b"".join(own), np.int64).tolist())
                    sketches.append((values & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["row", "id", "k", "n", "bands", "sketch"])

    return docs.select("_row", id_col, text_col).mapInArrow(tidy(sign), f"row bigint, id {docs.schema[id_col].dataType.simpleString()}, k binary, n int, bands array<bigint>, sketch binary")


def blocked(df: DataFrame, group: str, member: str, grams: str | None = None) -> DataFrame:
    """df's rows of groups of at least two members, with their _block of so many _blocks: about TILE members to a block,
    and, if column `grams` has their numbers of shingles, TILE_GRAMS of those. df is a written table, which is read twice:
    groups are counted by partial aggregation, and Spark splits the join that brings the counts where a group is hot."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"), F.sum(grams or F.lit(0)).alias("_g")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / TILE)
    if grams:
        blocks = F.greatest(blocks, F.least(F.ceil(F.col("_g") / TILE_GRAMS), F.col("_n")))
    dealt = df.join(sizes, group).withColumn("_blocks", blocks.cast("int")).drop("_n", "_g")
    return dealt.withColumn("_block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))


def tiles(df: DataFrame) -> DataFrame:
    """Each row of blocked() once for every tile (i, j) of two blocks that its own is one of."""
    other = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.select("*", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j")).drop("_blocks", "_other")


def candidate_links(t: pa.Table) -> pa.Table:
    """Of a tile of a bucket (k, sketch, block, i, j): a link from each member to the root of what it may be linked with."""
    keys = t["k"].to_pylist()
    m = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(len(keys), HASHES)
    block = t["_block"].to_numpy()
    sides = (block, t["i"][0].as_py(), t["j"][0].as_py())
    roots, unseen = Roots(len(keys)), np.ones(len(keys), bool)
    for start in range(len(keys)):  # breadth first: a member is compared with those not reached yet
        if not unseen[start]:
            continue
        unseen[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(unseen)
            if sides[1] != sides[2]:
                rest = rest[block[rest] != block[at]]
            if not len(rest):
                continue
            hit = rest[survivors(m, m, np.full(len(rest), at), rest)]
            unseen[hit] = False
            queue += hit.tolist()
            for x in hit.tolist():
                roots.join(at, x)
    out = [(keys[i], keys[r]) for i in range(len(keys)) if (r := roots.find(i)) != i]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def verified_links(t: pa.Table) -> pa.Table:
    """Of a tile of a family (k, copies, sketch, grams, block, i, j): each member's links in it and one link towards its root."""
    first: dict[bytes, int] = {}
    for at, k in enumerate(t["k"].to_pylist()):
        first.setdefault(k, at)
    keys, take = list(first), list(first.values())
    t = t if len(take) == t.num_rows else t.take(take)
    m = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(len(keys), HASHES)
    copies, block = t["copies"].to_numpy(), t["_block"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
    links, roots = np.zeros(len(keys), np.int64), Roots(len(keys))
    sizes = np.array([len(s) for s in sets])
    across = t["i"][0].as_py() != t["j"][0].as_py()
    found = []
    for at in range(len(keys)):
        rest = np.arange(at + 1, len(keys))
        if across:
            rest = rest[block[rest] != block[at]]
        rest = rest[np.minimum(sizes[rest], sizes[at]) >= THRESHOLD * np.maximum(sizes[rest], sizes[at])]
        rest = rest[survivors(m, m, np.full(len(rest), at), rest)]
        found.append(np.stack([np.full(len(rest), at), rest], axis=1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), int)
    common = common_counts(sets, pairs)
    linked = pairs[common >= THRESHOLD * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common)]
    np.add.at(links, linked[:, 0], copies[linked[:, 1]])
    np.add.at(links, linked[:, 1], copies[linked[:, 0]])
    for i, j in linked.tolist():
        roots.join(i, j)
    if t.nbytes > 1 << 20:
        del pairs, common, sets, m
        give_back()
    some = np.flatnonzero(links).tolist()
    return pa.table([pa.array([keys[i] for i in some], pa.binary()), pa.array(links[some], pa.int64()), pa.array([keys[roots.find(i)] for i in some], pa.binary())], names=["k", "links", "root"])


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> DataFrame:
    """(row, id, copies, n_links, class_id, kept) for every row of df.

    Two texts are linked if the Jaccard similarity of their sets of 5-word shingles (lower-case ASCII letters, digits and
    all non-ASCII as words; a shorter text is one shingle) is at least 0.8. copies: rows with an equal set, this one
    included. n_links: linked rows other than this. class_id: the least id among the rows connected with this one by
    links; kept: this row is the first of them (least id, then first in df). Texts without words (null, empty) have no
    links and stand alone. Null ids come after all others; repeated ids are rows of their own; only the two columns are
    read. A pair of similarity 0.8 is missed with probability below 1e-3 (bands, then tolerance).

    `stable`: df's rows come in the same partitions and order whenever it is computed, as a table scan's do; else it is
    written to the shared folder first. Equal sets are counted before anything is compared; buckets and families of any
    size are dealt out in tiles; the broadcast prefilter has at most SLOTS rows.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    docs = (docs if stable else written(docs, "jaccard-texts")).withColumn("_row", F.monotonically_increasing_id())
    rows = written(signatures(docs, "_id", "_text"), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = written(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("copies"), first.alias("first"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")), "classes")

    banded = tiles(blocked(classes.select("k", F.explode("bands").alias("bucket")), "bucket", "k"))
    seen = banded.join(classes.select("k", "sketch"), "k")
    edges = seen.groupBy("bucket", "i", "j").applyInArrow(candidate_links, "a binary, b binary")
    families = components(edges, "a", "b")

    known = families.join(classes.drop("bands"), families["node"] == classes["k"]).select("k", "component", "copies", "n", F.col("first.row").alias("_row"), "sketch")
    known = written(known, "family-members")
    members = written(blocked(known, "component", "k", "n").drop("n"), "families")
    forget(known)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int").alias("slot")
    slots = F.broadcast(members.select(slot("_row")).distinct())  # at most SLOTS rows of an int
    wanted = docs.select("_row", "_text", slot("_row")).join(slots, "slot", "left_semi").select("_row", "_text").join(members, "_row")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch, 0):
                if len(hashes) > WORD_HASHES:
                    hashes.clear()
                own = [shingles(x, hashes).tobytes() for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(own, pa.binary())], ["k", "component", "copies", "sketch", "_blocks", "_block", "grams"])

    sets = wanted.select("_text", "k", "component", "copies", "sketch", "_blocks", "_block").mapInArrow(tidy(grams), "k binary, component binary, copies bigint, sketch binary, _blocks int, _block int, grams binary")
    links = written(tiles(sets).groupBy("component", "i", "j").applyInArrow(verified_links, "k binary, links bigint, root binary"), "links")
    joined = components(links, "k", "root")

    counts = links.groupBy("k").agg(F.sum("links").alias("links"))
    linked = classes.select("k", "copies", "first").join(counts, "k").join(joined, F.col("k") == F.col("node"), "left")
    top = linked.groupBy(F.coalesce("component", "k").alias("component")).agg(F.min("first").alias("top"))
    named = linked.withColumn("component", F.coalesce("component", "k")).join(top, "component").select("k", "links", "top")
    full = classes.select("k", "copies", "first").join(named, "k", "left").select("k", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "first").alias("top"))
    out = rows.select("row", "id", "k").join(full, "k", "left")
    return out.select(
        "row", F.col("id").cast(id_type).alias(id_col), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("class_id"), F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document's class, copies and links; nulls, short texts and repeated rows as in jaccard_join."""
    return jaccard_join(table(spark, sf_dir, "documents"), stable=True).select("doc_id", "class_id", "copies", "n_links")


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates, the one of the least id (null last), of repeated rows the
    first. Null and empty texts stand alone and stay; an empty table stays empty."""
    plain = positional(docs if scanned(docs) else written(docs, "jaccard-docs"))
    found = jaccard_join(plain, named(docs, "doc_id"), named(docs, "text"), stable=True)
    rows = plain.withColumn("row", F.monotonically_increasing_id()).join(found.where("kept").select("row"), "row", "left_semi")
    return rows.select(*plain.columns).toDF(*docs.columns)
