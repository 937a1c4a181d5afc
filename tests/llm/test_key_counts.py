"""op12 moves whole sets only of texts that share enough keys, and loses no link by counting them."""

import random

import pytest

from caregrid.llm import jaccard, signature_tree


def _components(rows):
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in rows}
    root = {k: k for k in sets}
    for b in sets:
        for a in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_a_common_passage_moves_no_sets(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passages = [words(30) for _ in range(20)]  # each in two texts
    rows = [(k, " ".join(words(150) + passages[k // 2] + words(150))) for k in range(40)]
    rows.append((40, rows[7][1] + " more"))
    moved, picked = [], jaccard.picked
    monkeypatch.setattr(jaccard, "picked", lambda rows, wanted, width: moved.append(wanted.count()) or picked(rows, wanted, width))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(rows)
    assert sum(moved) == 2


@pytest.mark.parametrize("small", [3, 12, 128])
def test_links_by_counts_and_by_trees(spark, monkeypatch, small):
    """Pairs about the least similarity, of all ratios of size, in files on both sides of the bound."""
    rng = random.Random(6)
    rows = []
    for family in range(8):
        base = [f"{family}w{rng.randrange(10**6)}" for _ in range(80 + 10 * family)]
        for _ in range(12):
            copy = base[rng.randrange(8) : len(base) - rng.randrange(8)]
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(signature_tree, "SMALL", small)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _components(rows)
    assert {r.doc_id: r.component_id for r in got} == want and 8 < len(set(want.values())) < len(rows)
