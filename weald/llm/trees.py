"""Gradient-boosted trees with monotonic constraints, trained in numpy and flattened into node arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in one set of arrays. A leaf points to itself, so a fixed number of steps scores any row."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of x (rows by features), trees and rows vectorised together."""
        out = np.full(len(x), self.bias)
        if not len(self.roots) or not len(x):
            return out
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return out + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, monotonic: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: int = 8) -> Forest:
    """Newton boosting of the logistic loss on histograms.

    monotonic: feature -> +1 (score never falls as it rises) or -1. A split against it is not taken, and both children
    are held on their side of the split's midpoint, so the constraint holds for whole trees and their sum. With no rows,
    or one class only, the result is the constant prior.
    """
    n, m = x.shape
    prior = (y.sum() + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(n, bias)

        def leaf(v: float) -> int:
            at = len(nodes["value"])
            for k, q in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", v)):
                nodes[k].append(q)
            return at

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            own = float(np.clip(-gs / (hs + l2), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for j in range(m):
                    size = len(edges[j]) + 1
                    b = binned[rows, j]
                    gl, hl, cl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = (np.clip(-a / (c + l2), low, high) for a, c in ((gl, hl), (gs - gl, hs - hl)))
                    gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + l2) * vr**2) + gs * own + 0.5 * (hs + l2) * own**2
                    gain[(cl < least) | (len(rows) - cl < least) | ((vr - vl) * monotonic.get(j, 0) < 0)] = -1
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), (j, k, float(vl[k] + vr[k]) / 2))
            if best[1] is None:
                margin[rows] += rate * own
                return leaf(rate * own)
            j, k, mid = best[1]
            at, sign, goes = leaf(0.0), monotonic.get(j, 0), binned[rows, j] <= k
            bounds = ((low, mid), (mid, high)) if sign > 0 else ((mid, high), (low, mid)) if sign < 0 else ((low, high), (low, high))
            a, b = (grow(rows[s], g, h, level + 1, *lim) for s, lim in ((goes, bounds[0]), (~goes, bounds[1])))
            nodes["feature"][at], nodes["threshold"][at], nodes["left"][at], nodes["right"][at] = j, float(edges[j][k]), a, b
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -4.0, 4.0))
    return Forest(np.array(nodes["feature"], int), np.array(nodes["threshold"]), np.array(nodes["left"], int), np.array(nodes["right"], int), np.array(nodes["value"]), np.array(roots, int), depth, bias)


#: Gradients are summed as whole multiples of this, so that a sum is the same in any order and partitioning.
UNIT = 2.0**-24


def walked(tree: dict[str, np.ndarray], roots: np.ndarray, codes: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row of codes (rows by features) reaches from each root."""
    rows = np.arange(len(codes))[:, None]
    at = np.broadcast_to(roots, (len(codes), len(roots)))
    for _ in range(depth):
        at = np.where(codes[rows, tree["feature"][at]] <= tree["cut"][at], tree["left"][at], tree["right"][at])
    return at


def histograms(tree: dict[str, np.ndarray], roots: list[int], bias: float, depth: int, open_nodes: list[int], width: int, codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums (gradients and second derivatives in UNITs, rows) by open node of the last root's tree, feature and code."""
    at = walked(tree, np.array(roots), codes, depth)
    p = 1 / (1 + np.exp(-(bias + tree["value"][at[:, :-1]].sum(axis=1))))
    g, h = np.rint((p - y) / UNIT), np.rint(p * (1 - p) / UNIT)
    out = np.zeros((len(open_nodes), codes.shape[1], 3, width), np.int64)
    for k, node in enumerate(open_nodes):
        here = at[:, -1] == node
        for j in range(codes.shape[1]):
            for i, w in enumerate((g[here], h[here], None)):
                out[k, j, i] = np.bincount(codes[here, j], w, width).astype(np.int64)
    return out


def boosted(passes: Callable[..., np.ndarray], edges: list[np.ndarray], rows: int, positive: int, monotonic: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: int = 8) -> Forest:
    """train() over rows that stay where they are: passes(tree, roots, bias, depth, open nodes, width) has the histograms() of
    them all, one pass a level of a tree. `edges`: for each feature the bounds of its codes."""
    prior = (positive + 1) / (rows + 2)
    bias = float(np.log(prior / (1 - prior)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []
    width = max((len(e) + 1 for e in edges), default=1)

    def leaf() -> int:
        at = len(nodes["value"])
        for k, q in (("feature", 0), ("cut", 0), ("left", at), ("right", at), ("value", 0.0)):
            nodes[k].append(q)
        return at

    for _ in range(trees if 0 < positive < rows else 0):
        roots.append(leaf())
        bounds, values = {roots[-1]: (-4.0, 4.0)}, {}
        for _ in range(depth):
            if not bounds:
                break
            found = passes({k: np.array(v) for k, v in nodes.items()}, list(roots), bias, depth, list(bounds), width)
            below: dict[int, tuple[float, float]] = {}
            for (node, (low, high)), sums in zip(bounds.items(), found, strict=True):
                gs, hs, cs = (sums[0, i].sum() * u for i, u in enumerate((UNIT, UNIT, 1)))
                own = values[node] = float(np.clip(-gs / (hs + l2), low, high))
                best = (1e-6, None)
                for j, e in enumerate(edges if cs >= 2 * least else []):
                    gl, hl, cl = (np.cumsum(sums[j, i, : len(e) + 1])[:-1] * u for i, u in enumerate((UNIT, UNIT, 1)))
                    vl, vr = (np.clip(-a / (c + l2), low, high) for a, c in ((gl, hl), (gs - gl, hs - hl)))
                    gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + l2) * vr**2) + gs * own + 0.5 * (hs + l2) * own**2
                    gain[(cl < least) | (cs - cl < least) | ((vr - vl) * monotonic.get(j, 0) < 0)] = -1
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
                if best[1] is None:
                    continue
                j, k, vl, vr = best[1]
                mid, sign, two = (vl + vr) / 2, monotonic.get(j, 0), (leaf(), leaf())
                nodes["feature"][node], nodes["cut"][node], (nodes["left"][node], nodes["right"][node]) = j, k, two
                limits = ((low, mid), (mid, high)) if sign > 0 else ((mid, high), (low, mid)) if sign < 0 else ((low, high), (low, high))
                for child, v, lim in zip(two, (vl, vr), limits, strict=True):
                    below[child], values[child] = lim, float(np.clip(v, *lim))
            bounds = below
        for node, v in values.items():
            nodes["value"][node] = rate * v if nodes["left"][node] == node else 0.0
    threshold = np.array([edges[j][k] if at != left else 0.0 for at, (j, k, left) in enumerate(zip(nodes["feature"], nodes["cut"], nodes["left"], strict=True))], float)
    return Forest(np.array(nodes["feature"], int), threshold, np.array(nodes["left"], int), np.array(nodes["right"], int), np.array(nodes["value"], float), np.array(roots, int), depth, bias)
