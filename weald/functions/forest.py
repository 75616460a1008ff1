"""Minimum spanning forests of edge arrays, in numpy. Positions are the total order: edge 0 is the lightest."""

from __future__ import annotations

import numpy as np


def compact(*ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct vertices, and each array with their positions in place of them."""
    every = np.concatenate(ends)
    top = int(every.max()) + 1 if len(every) and every.min() >= 0 else 0
    if 0 < top <= 4 * len(every):  # a table of places is faster than a sort and searches, and no larger than the ends
        seen = np.zeros(top, bool)
        seen[every] = True
        place = np.cumsum(seen) - 1
        return np.flatnonzero(seen), [place[e] for e in ends]
    names = np.unique(every)
    return names, [np.searchsorted(names, e) for e in ends]  # places from unique() would take three times the memory


def roots_of(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def lightest(n: int, u: np.ndarray, v: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """Least position at each vertex: positions rise, so of writes in reverse order the last is the least."""
    best = np.full(n, none)
    for ends in (u, v):
        one = np.full(n, none)
        one[ends[::-1]] = at[::-1]
        np.minimum(best, one, out=best)
    return best


def contract(n: int, u: np.ndarray, v: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of forest edges, label of each vertex) of edges (u, v) in rising order.

    cut: for each vertex the position from which on an edge that isn't listed here may be lighter (the position of its
    lightest cut edge). A component is hooked along its lightest listed edge only if that comes before its cut; without
    `cut` the result is the whole forest.
    """
    label = np.arange(n)
    none = len(u)
    limit = np.full(n, none) if cut is None else np.minimum(cut, none)
    at = np.flatnonzero(u != v)
    u, v = u[at], v[at]
    chosen = []
    while len(at):
        best = lightest(n, u, v, at, none)
        best[best >= limit] = none
        asks = np.flatnonzero(best < none)
        if not len(asks):
            break
        place = np.searchsorted(at, best[asks])
        other = u[place] + v[place] - asks
        parent = np.arange(n)
        parent[asks] = other
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        chosen.append(np.unique(best[asks]))
        root = roots_of(parent)
        label = root[label]
        least = np.full(n, none)
        np.minimum.at(least, root, limit)
        limit = least
        u, v = root[u], root[v]
        keep = u != v
        at, u, v = at[keep], u[keep], v[keep]
    return (np.sort(np.concatenate(chosen)) if chosen else np.empty(0, int)), label


def light_first(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """contract() of many edges over few vertices: what the lightest ones connect already is left out of the rounds."""
    light = 4 * n
    if len(u) <= 2 * light:
        return contract(n, u, v)
    keep, label = contract(n, u[:light], v[:light])
    a, b = label[u[light:]], label[v[light:]]
    rest = np.flatnonzero(a != b)
    more, joined = contract(n, a[rest], b[rest])
    return np.concatenate([keep, light + rest[more]]), joined[label]


def order_of(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of edges in the total order (weight, u, v): by one number that packs all three where it fits, else by three."""
    if not len(u):
        return np.empty(0, int)
    bits = int(max(u.max(), v.max())).bit_length()
    if int(weight.max()).bit_length() + 2 * bits <= 63:
        return np.argsort(weight << 2 * bits | u << bits | v)  # ties are equal edges
    return np.lexsort((v, u, weight))


def kruskal(n: int, u: np.ndarray, v: np.ndarray, together: int = 1 << 18) -> np.ndarray:
    """Positions of the forest edges by union-find with path halving, edge by edge; so many at a time are Python's numbers."""
    up = list(range(n))
    out = []
    for at in range(0, len(u), together):
        for i, (a, b) in enumerate(zip(u[at : at + together].tolist(), v[at : at + together].tolist(), strict=True), at):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append(i)
    return np.array(out, int)


def filter_kruskal(n: int, u: np.ndarray, v: np.ndarray, small: int = 4096) -> np.ndarray:
    """Positions of the forest edges, half by half: edges within a component of the lighter half are dropped unsorted."""
    label = np.arange(n)
    out = []

    def solve(at: np.ndarray) -> None:
        nonlocal label
        a, b = label[u[at]], label[v[at]]
        at, a, b = at[a != b], a[a != b], b[a != b]
        if len(at) > small:
            solve(at[: len(at) // 2])
            solve(at[len(at) // 2 :])
        elif len(at):
            chosen, joined = contract(n, a, b)
            out.append(at[chosen])
            label = joined[label]

    solve(np.arange(len(u)))
    return np.sort(np.concatenate(out)) if out else np.empty(0, int)
