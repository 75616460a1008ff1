"""Flattened trees against walking them node by node, and their constraints."""

import numpy as np
import pytest

from weald.llm import trees


def walked(f: trees.Forest, row) -> float:
    total = f.bias
    for at in f.roots:
        while f.left[at] != at:
            at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
        total += f.value[at]
    return total


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 4)), 1)  # ties
    y = (x[:, 0] - 0.5 * x[:, 1] ** 2 + rng.normal(size=400) * 0.5 > 0).astype(int)
    return x, y


def test_node_arrays_agree_with_walking(data):
    x, y = data
    f = trees.train(x, y, {0: 1}, trees=25, depth=4)
    assert len(f.roots) == 25 and (f.left[f.roots] != f.roots).any()
    assert np.allclose(f.margin(x), [walked(f, r) for r in x])
    assert ((f.score(x) >= 0.5) == y).mean() > 0.85
    assert len(f.margin(x[:0])) == 0


@pytest.mark.parametrize(("feature", "sign"), [(0, 1), (1, -1)])
def test_constraints_hold_everywhere(data, feature, sign):
    x, y = data
    f = trees.train(x, y, {feature: sign}, trees=25, depth=4)
    for row in x[:50]:
        line = np.repeat(row[None], 61, axis=0)
        line[:, feature] = np.linspace(-3, 3, 61)
        assert (np.diff(f.margin(line)) * sign >= -1e-12).all()


def test_one_class_or_no_rows_give_the_prior(data):
    x, _ = data
    assert np.allclose(trees.train(x, np.ones(len(x), int), {}).score(x), 401 / 402)
    assert np.allclose(trees.train(x[:0], np.zeros(0, int), {}).score(x), 0.5)
