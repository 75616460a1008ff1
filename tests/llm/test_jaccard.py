"""The Jaccard join against all pairs."""

import random
import re

import pytest

pytest.importorskip("weald.llm")

from tests.llm.data import DOCS, docs
from weald.llm import jaccard
from weald.llm.components import components


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(linked):
            label[i] = min([label[i], *(label[j] for j in js)])
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    out = []
    for i, (d, _) in enumerate(rows):
        group = [j for j in range(len(rows)) if label[j] == label[i]]
        out.append((str(d), 1 + sum(sets[j] == sets[i] for j in linked[i]), len(linked[i]), str(rows[min(group, key=order)][0])))
    return sorted(out)


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = list(DOCS)
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.choice([60, 120, 300]))]
        for copy in range(25):
            changed = list(text)
            for _ in range(rng.randrange(0, 5)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append((1000 * base + copy + 10_000, " ".join(changed)))
    return rows


@pytest.mark.parametrize(("tile", "grams"), [(512, 300_000), (4, 300_000), (512, 700)])
def test_join_equals_all_pairs(spark, monkeypatch, tile, grams):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "TILE_GRAMS", grams)
    rows = near_texts()
    found = jaccard.jaccard_join(docs(spark, rows).repartition(3)).collect()
    got = sorted((str(r["doc_id"]), r["copies"], r["n_links"], str(r["class_id"])) for r in found)
    expected = brute(rows)
    assert got == expected
    assert sum(r["kept"] for r in found) == len({x[3] for x in expected if x[0] not in ("0", "1", "2", "-9", "None")}) + 5


def test_no_link_of_the_documents_is_lost(spark):
    """Against all pairs that share a shingle, on sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: grams(r["text"]) for r in docs.collect()}
    holders, common = {}, {}
    for i in sorted(sets):
        for g in sets[i]:
            for j in holders.setdefault(g, []):
                common[j, i] = common.get((j, i), 0) + 1
            holders[g].append(i)
    links = dict.fromkeys(sets, 0)
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
    assert sum(links.values()) > 20
    assert {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(docs, stable=True).collect()} == links


def test_empty_table(spark):
    assert jaccard.jaccard_join(docs(spark, [])).count() == 0


def test_posterior_limits():
    limits = jaccard.least_matches()
    assert len(limits) == 8 and list(limits) == sorted(limits)
    assert 80 < limits[-1] < 102  # at 128 values, well below 0.8 * 128


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
