"""The conversation trie against one built from whole prefixes."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

pytest.importorskip("weald.llm")

from weald.llm import tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_convs string, node int"


def key(role, text):
    return sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", key(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)

    def sums(n):
        below = [sums(x) for x in children[n]]
        return sum(x[0] for x in below) + (not below), sum(x[1] for x in below) + (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)

    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), *sums(n), sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def found(spark, rows):
    df = tries.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def expected(rows):
    return sorted(plain(rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_families(spark):
    rng = random.Random(5)
    rows = []
    for c in (*range(0, 30), *range(100, 140), *range(205, 220), 340, 10**12 + 7):
        for t in range(rng.choice([0, 1, 1, 2, 3, 6, 9, 14])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é𝔘", "", None]), "x", 1))
    rows += rng.sample(rows, 20)  # repeats
    rows += [(None, 1, "user", "x", "x", 1)]
    assert found(spark, rows) == expected(rows)


def test_same_turns_in_many_families(spark):
    rows = [(c, t, "user", f"t{t}", "x", 1) for c in range(0, 1200, 3) for t in range(3)]
    assert found(spark, rows) == expected(rows)


def test_long_conversation_beside_short_ones(spark):
    rows = [(100, t, "user", f"t{t % 7}", "x", 1) for t in range(500)] + [(c, t, "user", f"t{t % 7}", "x", 1) for c in (101, 102, 103) for t in range(c - 80)] + [(200, 0, "user", "only", "x", 1)]
    assert found(spark, rows) == expected(rows)


def test_turnless_and_empty(spark):
    alone = next(c for c in range(101, 199) if tries.head_length(c) > 1)  # its base is absent, and it has too few turns
    assert found(spark, [(alone, 0, "user", "x", "x", 1)]) == [(alone, 0, None, 1, 0, 1, 0, sha256(str(alone).encode()).hexdigest())]
    assert found(spark, []) == []


def test_ends_of_many_rows_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOB", 40)
    rows = [(c, t, "user", "same", "x", 1) for c in range(0, 900) for t in range(6)]
    assert found(spark, rows) == expected(rows)
