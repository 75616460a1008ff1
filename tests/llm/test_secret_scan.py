"""Secret scans against Python's regular expressions, and the automata by themselves."""

import re

import numpy as np
import pytest

pytest.importorskip("weald.llm")

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import DOCS, docs
from weald.llm import secret_scan as s

PARTS = ["token", "TOKEN", "secret", "api_key", "apikey", "passwd", "AKIA", "ABCDEFGHIJKLMNOP", "abcdef0123456789abcdef01", "=", ":", " ", '"', "'", "é", "ſ", "K", "x", "ghp_" + "a1" * 18, "eyJ", "abcdefgh", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "Bearer ", "12345678", "://u:p@", "\n", "AIza" + "b" * 35]


def plain(text):
    found = []
    for k, r in enumerate(s.RULES):
        for m in re.finditer(f"(?P<head>{r.head})(?P<body>{r.body})", text or "", (re.I | re.A) if r.ignore_case else 0):
            if len(m["body"]) >= r.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=12))
@settings(max_examples=300, deadline=None)
def test_spans_are_those_of_regular_expressions(texts):
    assert s.scanner(s.RULES)([t.encode() for t in texts]) == [plain(t) for t in texts]


def test_runs_over_many_chunks():
    texts = ["0123456789abcdef" * 3000, "token=" + "A" * 70_000 + " x " + "AKIA" * 9000, "a" * 23 + " " + "é" * 200 + "b" * 24]
    assert s.scanner(s.RULES)([t.encode() for t in texts]) == [plain(t) for t in texts]


def test_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 50)
    texts = ["é" * 99 + "token=" + "A" * 70 + "secret: abcdefgh" + "x" * 140 + "AKIA" * 9, "", "0123456789abcdef" * 30, "é password = geheim1"]
    assert s.scanner(s.RULES)([t.encode() for t in texts]) == [plain(t) for t in texts]


def test_dropped_matches_hide_what_they_cover():
    assert s.scanner(s.RULES)([b"token=token:abcdefgh"]) == [[]]
    assert s.scanner(s.RULES)([b"token=tok token:abcdefgh"]) == [[(10, 0, 24)]]


def test_minimal_automaton():
    a = s.Automaton.of([("(a|b)*abb", False)], anywhere=False)
    assert len(a.accepts) == 5 * (a.kinds.max() + 1)  # the textbook's four states and the dead one
    assert a.longest(b"abbaabbc", 0) == 7 and a.longest(b"cabb", 0) == -1
    with pytest.raises(ValueError):
        s.Automaton.of([("a*", False)], anywhere=False)
    with pytest.raises(ValueError):
        s.Automaton.of([("[^a]", False)], anywhere=False)


@given(st.binary(max_size=2000))
@settings(max_examples=50, deadline=None)
def test_passing_chunks_in_step_finds_the_states_of_one_pass(data):
    a, state, want = s.scanner(s.RULES).all, 0, []
    for byte in data:
        state = int(a.moves[state + a.kinds[byte]])
        want.append(state)
    assert a.states(np.frombuffer(data, np.uint8)).tolist() == want


def test_over_rows(spark):
    rows = [*DOCS, (20, "password: hunter22"), (20, "password: hunter22")]
    df = docs(spark, rows).selectExpr("*", "'mine' AS secrets", "1 AS `a.b`")
    got = s.scan_secrets(df)
    assert got.columns == [*df.columns, "secrets_2"]
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["secrets"], [(x["start"], x["kind"], x["end"]) for x in r["secrets_2"]]) for r in got.collect()), key=repr)
    assert found == sorted(((i is None, i or 0, "mine", [(a, s.RULES[k].kind, b) for a, k, b in plain(t)]) for i, t in rows), key=repr)
    assert s.scan_secrets(docs(spark, [])).count() == 0
