"""The manifest against trees built in one piece, and traversal against whole blocks."""

import zlib
from hashlib import sha256

import pytest

pytest.importorskip("weald.llm")

from pyspark.sql import functions as F

from tests.llm.data import DOCS
from weald.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, place string, n int, digest string, tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def proofs(nodes):
    """(root, siblings to the left and right of every node, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], paths


def plain(rows):
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = {c: c + 32 for c in range(65, 91)}
    sources = {}
    for i, text, lang, source, n, *_ in rows:
        leaf = h(say(i), say(source), say(lang), say(n), say(text))
        low = h(say(i), say(source), say(lang), say(n), say(text.translate(lower) if text is not None else None))
        sources.setdefault(source, []).append(((i is not None, i or 0), leaf, low if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf, i))
    names = sorted(sources, key=lambda x: (x is not None, (x or "").encode()))
    trees = {s: proofs([x[1] for x in sorted(sources[s])]) for s in names}
    if not names:
        return []
    root, tops = proofs([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, leaf, other, i), path in zip(sorted(sources[s]), trees[s][1], strict=True):
            fold = other
            for left, right in path + top:
                fold = h(left, fold, right)
            out.append((i, leaf, trees[s][0], root, h(*(a + b for a, b in path + top)), fold, fold == root))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    return merkle.manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 300, 4096])
def test_traversal(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = next(k for k in range(4) if 16**k >= n)
    root, paths = proofs(leaves)
    assert merkle.block_root(leaves, levels) == root
    assert list(merkle.traversal(leaves, levels)) == paths


def test_traversal_holds_little():
    stack = merkle.Treehash(2)
    for i in range(3000):
        stack.add(str(i))
        assert sum(map(len, stack.runs[:-1])) <= 2 * 15
    part = merkle.traversal([h(str(i)) for i in range(40)], 3)  # the last part of a larger tree: levels go on
    assert all(len(p) == 3 for p in part)


def test_manifest(spark, monkeypatch):
    """Blocks of 16 leaves, so that there are several steps; many rows in one source, sources without end."""
    rows = [(i, t, None, "s", None) for i, t in DOCS] + [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i % 40:02d}", i) for i in range(100, 1000)]
    rows += [(1, "Only one", "de", None, 3), (2, "A Z", None, "é", 0), (2, "A Z", None, "é", 0), (None, "x", "de", None, 3)]
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    got = [tuple(r) for r in found(spark, rows)]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert not all(r[-1] for r in got)


def test_small_tables(spark):
    assert found(spark, []) == []
    for rows in ([(7, "A", "en", "s", 1)], [(7, "A", "en", "s", 1), (8, None, "en", None, 1)]):
        assert sorted((tuple(r) for r in found(spark, rows)), key=repr) == sorted(plain(rows), key=repr)
