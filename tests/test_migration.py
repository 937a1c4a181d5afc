from caregrid.operators import graph, scans
from caregrid.operators.migration import Migration, Move


def test_mismatch_leaves_no_marker(spark, tmp_path):
    rows = spark.createDataFrame([("a", '{"n": 1, "at": "2024-01-01T02:00:00+02:00"}'), ("a", '{"n": 9}'), ("b", "{broken"), (None, '{"n": 3}')], "k string, body string")
    move = lambda rows, change=None: Move(rows, "k", "body", "n int, at string", ["at"], change)
    job = Migration(spark, str(tmp_path / "m"))
    assert job.read("t") is None and job.runs() == []
    lossy = job.run({"t": move(rows), "u": move(rows, lambda x: x.filter("k = 'a'"))})
    assert {r.name: (r.held, r.added, r.expected, r.agreed) for r in lossy.collect()} == {"t": (0, 3, 3, True), "u": (0, 1, 3, False)}
    assert job.runs() == [] and job.runs(marked=False) == [0] and job.read("t") is None
    job.run({"t": move(rows.filter("body <> '{\"n\": 9}'")), "u": move(rows.limit(0))})
    assert job.runs() == [1]
    got = {r.k: (r.n, str(r["at"])) for r in job.read("t").collect()}
    assert got == {"a": (1, "2024-01-01 00:00:00"), "b": (None, "None"), None: (3, "None")}
    assert job.read("u").count() == 0
    more = spark.createDataFrame([("b", '{"n": 7}'), ("c", '{"n": 8}')], "k string, body string")
    assert tuple(job.run({"t": move(more)}).first()) == ("t", 3, 1, 4, True)
    assert {r.k: r.n for r in job.read("t").collect()} == {"a": 1, "b": None, "c": 8, None: 3}
    assert job.read("u").count() == 0  # as an earlier run left it


def test_census(spark):
    paths = ["a/B.Py", "a/B.Py", "x.py", "Dockerfile", "src/makefile", "README", ".git/a.py", "a/node_modules/b.js", "a/.hid/c.js", ".env", "build.js", None, "z."]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.ext: (r.n, r.total, r.truncated) for r in scans.census(files).collect()}
    assert got == {"py": (2, 7, False), "dockerfile": (1, 7, False), "makefile": (1, 7, False), "env": (1, 7, False), "js": (1, 7, False), "": (1, 7, False)}
    assert {(r.total, r.truncated) for r in scans.census(files, most=3).collect()} == {(3, True)}
    assert scans.census(files.limit(0)).count() == 0


def test_omitted_packs(spark):
    packs = [scans.Pack("a", {"x": ["foo"], "y": ["nope"]}), scans.Pack("b", {"x": ["foo", "bar"], "z": ["b.r"]}), scans.Pack("c", {"w": ["never"]})]
    files = spark.createDataFrame([("p", "some bar"), ("q", None)], "path string, text string")
    assert [(r.pack, r.systems) for r in scans.omitted_packs(files, packs, ["a"]).collect()] == [("b", ["x", "z"])]
    assert scans.omitted_packs(files, packs, ["a", "b", "c"]).count() == 0 == scans.omitted_packs(files.limit(0), packs, []).count()


def test_diagram_shapes(spark):
    names = [("g", f"k{i:02}", f"n{i}", "Concept") for i in range(11)] + [("g", "s", 'a "b" [c]', "Session"), ("g", "t", "x" * 41, "MemoryCard"), ("g", "u", None, None)]
    nodes = spark.createDataFrame(names, "graph string, node string, name string, label string")
    edges = spark.createDataFrame([("g", "k10", "s", "HAS_ONE"), ("g", "k01", "t", "IS"), ("g", "k01", "gone", "IS")], "graph string, src string, dst string, type string")
    lines = graph.diagram_text(nodes, edges, "LR").first().code.split("\n")
    assert lines[0] == "flowchart LR" and [x.split("[")[0] for x in lines[1:12]] == [f"    N{k}" for k in range(1, 12)]
    assert lines[12:] == ["    N12>a 'b' (c)]", "    N13([" + "x" * 37 + "...])", "    N14[u]", "    N2 -->|is| N13", "    N11 -->|has one| N12"]


def test_concept_document(spark):
    concepts = spark.createDataFrame([(i, f"t{i}", "tag", i * 10) for i in range(1, 5)], "node int, term string, tag string, extra int")
    is_a = spark.createDataFrame([(2, 1), (3, 1), (3, 1), (4, 1), (4, 99), (98, 1)], "child int, parent int")
    others = spark.createDataFrame([(2, "SITE", 4, 1), (2, "SITE", 4, 1), (2, "SITE", 99, 1)], "src int, type string, dst int, grp int")
    maps = spark.createDataFrame([(3, "B", 1, 2, None), (3, "A", 1, 10, "x"), (3, "C", 1, 1, "y")], "node int, code string, grp int, priority int, advice string")
    got = {r.node: r for r in graph.concept_document(concepts, is_a, others, maps, most=2).collect()}
    assert {k: [x.end for x in r.parents] for k, r in got.items()} == {1: [], 2: [1], 3: [1], 4: [1]}
    assert [(x.end, x.term) for x in got[1].children] == [(2, "t2"), (3, "t3")] and got[2].children == []
    assert [tuple(x) for x in got[2].relationships] == [("SITE", 4, 1, "t4")] and [x.code for x in got[3].codes] == ["C", "B", "A"] and got[4].extra == 40


def test_drug_document(spark):
    drugs = spark.createDataFrame([(1, "a", "IN"), (2, "b", "SCD"), (3, None, None)], "node int, term string, kind string")
    links = spark.createDataFrame([(1, "HAS", 2), (1, "HAS", 2), (1, "ALSO", 3), (1, "Z", 1), (1, "HAS", 77), (77, "HAS", 1)], "src int, type string, dst int")
    concepts = spark.createDataFrame([(9, "nine", "tag")], "node int, term string, tag string")
    crosswalk = spark.createDataFrame([(2, 9), (2, 9), (2, 8), (None, 9)], "node int, concept int")
    got = {r.node: r for r in graph.drug_document(drugs, links, crosswalk, concepts, most=2).collect()}
    assert [tuple(x) for x in got[1].relationships] == [("ALSO", 3, None, None), ("HAS", 2, "b", "SCD")] and got[1].crossrefs == []
    assert got[2].relationships == [] and [tuple(x) for x in got[2].crossrefs] == [(9, "nine", "tag")] and got[3].crossrefs == []
