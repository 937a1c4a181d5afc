from caregrid.operators import casemix, graph, tables
from pyspark.sql import functions as F


def test_cmi_case(spark):
    mix = spark.createDataFrame([(1, 2024, 10, 100.0), (1, 2024, 11, 300.0), (2, 2024, 10, 0.0)], "provider int, year int, drg int, discharges double")
    weights = spark.createDataFrame([(10, 2.0), (11, 1.0)], "drg int, weight double")
    got = {r.provider: (r.cmi, r.discharges, r.n_drgs) for r in casemix.case_mix_index(mix, weights).collect()}
    assert got == {1: (1.25, 400.0, 2), 2: (None, 0.0, 1)}


def test_cmi_ties_go_up(spark):
    """Exactly 1.23325, 1.53865, 1.89795 and 1.35355, of which sums of doubles are just below in any order."""
    cases = [([1.02175, 1.57165], [8, 5]), ([1.22922, 1.84808], [24, 24]), ([1.8769, 1.90637], [12, 30]), ([1.35415, 1.3534], [12, 48])]
    rows = [(p, 2 * p + k, w, float(d)) for p, case in enumerate(cases) for k, (w, d) in enumerate(zip(*case))]
    mix = spark.createDataFrame([(p, 2024, g, d) for p, g, _, d in rows], "provider int, year int, drg int, discharges double")
    weights = spark.createDataFrame([(g, w) for _, g, w, _ in rows], "drg int, weight double")
    got = {r.provider: r.cmi for r in casemix.case_mix_index(mix, weights).collect()}
    assert got == {0: 1.2333, 1: 1.5387, 2: 1.898, 3: 1.3536}


def test_benchmark_of_tied_indexes(spark):
    """Two providers at exactly 1.53865 and 1.23325: ranks and gaps go by 1.5387 and 1.2333."""
    mix = spark.createDataFrame([(1, 2024, 1, 72.0), (1, 2024, 2, 72.0), (2, 2024, 3, 80.0), (2, 2024, 4, 50.0), (3, 2024, 5, 200.0)], "provider int, year int, drg int, discharges double")
    weights = spark.createDataFrame([(1, 1.22922), (2, 1.84808), (3, 1.02175), (4, 1.57165), (5, 1.2333)], "drg int, weight double")
    place = spark.createDataFrame([(p, f"n{p}", "X", "T") for p in (1, 2, 3)], "provider int, name string, state string, type string")
    rows = casemix.benchmark(casemix.case_mix_index(mix, weights), place).select("provider", "cmi", "national", "in_state", "gap", "revenue_gap").collect()
    assert sorted(map(tuple, rows)) == [(1, 1.5387, 100, 100, -0.3054, -316638.72), (2, 1.2333, 67, 67, 0.0, 0.0), (3, 1.2333, 67, 67, 0.0, 0.0)]


def test_ancestors(spark):
    edges = spark.createDataFrame([(4, 2), (4, 3), (2, 1), (3, 1)], "child int, parent int")
    assert {(r.ancestor, r.distance) for r in graph.ancestors(edges, 5).filter("node = 4").collect()} == {(2, 1), (3, 1), (1, 2)}
    assert graph.ancestors(edges, 5, paths=True).filter("node = 4").count() == 4
    up = {(r.node, r.ancestor) for r in graph.ancestors(edges, 3).collect()}
    assert up == {(r.descendant, r.node) for r in graph.descendants(edges, 3).collect()}


def test_upsert_twice(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, t string, n int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 3)], "k int, t string, n int")
    once = tables.upsert(old, new, "k", ["t"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]
    assert sorted(map(tuple, tables.upsert(once, new, "k", ["t"]).collect())) == sorted(map(tuple, once.collect()))


def test_diagram(spark):
    code = "graph TD\n%% note\nA[Start] --> B{Ok?}\nB -->|yes| C([Done])\nB --> D"
    nodes, edges = graph.diagram_rows(spark.createDataFrame([("x", code)], "diagram_id string, code string"))
    assert {(r.id, r.label) for r in nodes.collect()} == {("A", "Start"), ("B", "Ok?"), ("C", "Done"), ("D", "D")}
    assert {(r.src, r.dst, r.label) for r in edges.collect()} == {("A", "B", None), ("B", "C", "yes"), ("B", "D", None)}


def test_percentile_of_one_row(spark):
    cmi = spark.createDataFrame([(1, 2024, 1.5, 500.0, 3)], "provider int, year int, cmi double, discharges double, n_drgs int")
    place = spark.createDataFrame([(1, "n", "X", "T")], "provider int, name string, state string, type string")
    rows = casemix.peer_percentiles(cmi, place).select("p10", "median", "p90").distinct().collect()
    assert [tuple(r) for r in rows] == [(1.5, 1.5, 1.5)]
    assert casemix.percentile_rank(cmi, place).select(F.col("national")).first()[0] == 100
