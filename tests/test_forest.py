"""Array forests and the numeric helpers against plain versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weald.functions import forest, varint

EDGES = st.integers(1, 12).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=40)))


@given(EDGES)
@settings(max_examples=300, deadline=None)
def test_strategies_agree(case):
    n, pairs = case
    u, v = (np.array([p[i] for p in pairs], int) for i in (0, 1))
    plain = forest.kruskal(n, u, v).tolist()
    assert forest.contract(n, u, v)[0].tolist() == plain
    assert forest.filter_kruskal(n, u, v, small=3).tolist() == plain


@given(EDGES, st.integers(0, 11))
@settings(max_examples=300, deadline=None)
def test_contraction_with_cuts_takes_forest_edges_only(case, border):
    n, pairs = case
    u, v = (np.array([p[i] for p in pairs], int) for i in (0, 1))
    whole = set(forest.kruskal(n, u, v).tolist())
    inside = np.flatnonzero((u <= border) & (v <= border))
    cut = np.full(n, len(u))
    for i in range(len(u) - 1, -1, -1):
        for a, b in ((u[i], v[i]), (v[i], u[i])):
            if a <= border < b:
                cut[a] = i
    keep, label = forest.contract(n, u[inside], v[inside], np.searchsorted(inside, cut))
    assert set(inside[keep].tolist()) <= whole
    for i in range(n):
        assert label[label[i]] == label[i]


@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
@settings(max_examples=200, deadline=None)
def test_varint_round_trip(values):
    data = varint.encode(np.array(values, np.int64))
    assert varint.decode(data).tolist() == values
    assert len(data) == sum(max(1, -(-x.bit_length() // 7)) for x in values)


def test_varint_errors():
    with pytest.raises(ValueError):
        varint.encode(np.array([-1]))
    with pytest.raises(ValueError):
        varint.decode(b"\x80")
    with pytest.raises(ValueError):
        varint.decode(b"\xff" * 10 + b"\x01")
    src, dst, w = np.array([0, 0, 5]), np.array([3, 4, 0]), np.array([7, 300, 1])
    assert [x.tolist() for x in varint.decode_edges(varint.encode_edges(src, dst, w))] == [src.tolist(), dst.tolist(), w.tolist()]
