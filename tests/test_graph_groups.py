"""Neighbourhoods by groups of seeds and lineage by pruned neighbours, against plain searches."""

import random
from collections import defaultdict

import pytest
from caregrid.operators import graph


def walked(edges, seed, depth):
    """node -> distance, the seed left out."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, front = {seed: 0}, {seed}
    for k in range(1, depth + 1):
        front = {b for a in front for b in near[a]} - set(out)
        out |= dict.fromkeys(front, k)
    return {v: k for v, k in out.items() if v != seed}


@pytest.fixture
def tables(monkeypatch):
    """name -> rows of each table that the graph operators write."""
    real, seen = graph.written, defaultdict(list)

    def written(df, name):
        out = real(df, name)
        seen[name].append(out.count())
        return out

    monkeypatch.setattr(graph, "written", written)
    return seen


@pytest.mark.parametrize("kind", ["int", "string"])
def test_neighborhood_of_many_groups(spark, monkeypatch, tables, kind):
    """Any group, part and cut gives the distances of a plain search; the last frontier, the largest, is not written."""
    monkeypatch.setattr(graph, "SEEDS", 3)
    monkeypatch.setattr(graph, "STEPS", 40)
    rng, name = random.Random(4), int if kind == "int" else "n{}".format
    edges = [(name(0), name(rng.randrange(90))) for _ in range(30)] + [(name(rng.randrange(90)), name(rng.randrange(90))) for _ in range(110)]
    seeds = [name(k) for k in (0, 5, 17, 23, 40, 61, 88, 200)]
    rows = spark.createDataFrame([*edges, (name(7), None), (None, name(8))], f"src {kind}, dst {kind}")
    for depth in (1, 2, 3):
        tables.clear()
        got = graph.neighborhood(rows, spark.createDataFrame([(s,) for s in [*seeds, seeds[0]]], f"node {kind}"), depth, hub=8).collect()
        assert sorted(map(tuple, got)) == sorted((s, v, k) for s in seeds for v, k in walked(edges, s, depth).items())
        assert len(tables["frontier"]) == depth - 1


def test_lineage_of_any_labels(spark, monkeypatch):
    monkeypatch.setattr(graph, "SEEDS", 4)
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(0, k) for k in range(0, 60, 4)]
    labels = {k: "a" if k % 3 else "b" for k in range(60)}
    nodes, anchors = spark.createDataFrame(list(labels.items()), "node int, label string"), [0, 1, 2, 9, 30, 45, 59]
    rows = spark.createDataFrame(edges, "src int, dst int")
    for steps, n in ((1, 3), (2, 4), (3, 2), (3, 50)):
        got = graph.artifact_lineage(rows, spark.createDataFrame([(s,) for s in anchors], "node int"), nodes, ["b"], steps, n).select("seed", "node", "label", "distance", "place").collect()
        want = []
        for s in anchors:
            near = sorted((k, v) for v, k in walked(edges, s, steps).items() if labels[v] == "b")[:n]
            want += [(s, v, "b", k, place) for place, (k, v) in enumerate(near, 1)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_lineage_does_not_list_all_pairs(spark, tables):
    """300 sessions that share a word: an anchor looks at the first few, not at all."""
    rows = spark.createDataFrame([(f"c{k:03d}", "word") for k in range(300)], "src string, dst string")
    nodes = rows.selectExpr("src AS node", "'session' AS label")
    got = graph.artifact_lineage(rows, nodes.select("node"), nodes, ["session"], 3, 5)
    assert {r.node for r in got.filter("seed = 'c200'").collect()} == {f"c{k:03d}" for k in range(5)} and got.count() == 1500
    assert max(map(max, tables.values())) <= 1500
