"""Containment and shared-word joins, dictionary passes and neighborhoods with hubs against plain versions."""

import itertools
import random
import re

from caregrid.functions import vocabulary as vo
from caregrid.operators import graph as gr
from caregrid.operators import notes as nt
from caregrid.operators import records as rc
from caregrid.operators import retrieval as rt
from caregrid.operators import textjoin as tj
from pyspark.sql import functions as F


def test_joins_equal_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    texts = sorted({" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"", "aa", "a"})
    needles = sorted({rng.choice(texts)[rng.randint(0, 3) :][: rng.randint(1, 7)] for _ in range(150)} | {"", "zzz", "a", "ab"})
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    got = sorted(map(tuple, tj.contained(n, t).collect()))
    assert got == sorted((a, b) for a in needles for b in texts if a and a in b) and len(got) > 500
    split = lambda x: x.split(" ")
    sets = spark.createDataFrame([(x, split(x)) for x in texts], "name string, words array<string>")
    rows = spark.createDataFrame([(x, split(x)) for x in texts], "text string, words array<string>")
    got = sorted(map(tuple, tj.sharing(sets, rows, F.floor(F.size("words") / 2) + 1).collect()))
    assert got == sorted((a, b) for a, b in itertools.product(texts, texts) if len(set(split(a)) & set(split(b))) >= len(set(split(a))) // 2 + 1)


def test_no_nested_loop(spark):
    """The plan of the rule cascade holds no nested loop and no cross join, broadcast or not."""
    concepts = spark.createDataFrame([("1", "heart failure"), ("2", "acute chest pain")], "code string, term string")
    rules = spark.createDataFrame([("r", "chest pain", ["9"]), ("s", "left heart failure", ["8"])], "rule_id string, condition string, codes array<string>")
    edges = spark.createDataFrame([("1", "8")], "child string, parent string")
    found = nt.matching_rules(concepts, rules, edges)
    assert sorted(map(tuple, found.collect())) == [("1", "heart failure", "s", 2), ("2", "acute chest pain", "r", 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_in_one_pass(spark):
    """The same names as a pattern for each: names within names, at edges, side by side, in any case, over whole documents."""
    names = [*vo.MEDICATIONS, *vo.CONDITION_SHORT]
    rng = random.Random(2)
    made = [rng.choice(["", "x", "-", " "]).join(rng.choice(names + ["no", "é"]) for _ in range(6)) for _ in range(200)]
    terms = [n for own in vo.NOTE_TERMS.values() for n in own]
    made += [rng.choice(["", "s ", " "]).join(rng.choice(terms) for _ in range(5)) for _ in range(200)]
    docs = spark.createDataFrame([(x,) for x in made], "text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lower("text").alias("text")))
    got = docs.select("text", nt._named_in(F.col("text"), names, True).alias("w"), nt._named_in(F.col("text"), terms, False).alias("t")).collect()
    for r in got:
        whole = {n for n in names if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", r.text)}
        assert set(r.w) == whole and set(r.t) == {n for n in terms if n in r.text}


def test_neighborhood_with_hubs(spark):
    """Hubs in parts give the same rows; no hop stands twice in the plan; both directions of a node search."""
    rng = random.Random(1)
    pairs = [(f"n{rng.randint(0, 60)}", f"n{rng.choice([0, 1, rng.randint(0, 60)])}") for _ in range(200)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n7",), ("gone",)], "node string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for seed in ("n0", "n7", "gone"):
        seen, front = {seed}, {seed}
        for k in (1, 2):
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
            want |= {(seed, y, k) for y in front}
    for hub in (3, 1 << 16):
        got = gr.neighborhood(edges, seeds, 2, hub)
        assert {tuple(r) for r in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert gr.neighborhood(edges, seeds.filter("node = 'gone'"), 3).collect() == []
    nodes = spark.createDataFrame([("a", "hit"), ("b", "x"), ("c", "HIT two"), ("d", "hit alone")], "node string, name string")
    steps = spark.createDataFrame([("b", "a"), ("a", "c")], "src string, dst string")
    got = sorted(map(tuple, gr.node_search(nodes, steps, "Hit", ["name"]).collect()), key=str)
    assert got == [("a", "b"), ("a", "c"), ("c", "a"), ("d", None)]


def test_tool_grounding(spark):
    calls = [("a", 400, 1), ("a", 200, 2), ("b", 400, 1), ("b", 200, 3), ("c", 101, 1), ("d", 100, None), ("e", None, 1)]
    got = {r.q: (r.calls, r.bytes, r.overall, r.label) for r in rt.tool_grounding(spark.createDataFrame(calls, "q string, bytes long, round int"), 3).collect()}
    assert got == {"a": (2, 600, 0.95, "High"), "b": (2, 600, 0.7, "Medium"), "c": (1, 101, 0.7, "Medium"), "d": (1, 100, 0.35, "Low"), "e": (1, 0, 0.35, "Low")}


def test_many_searches_equal_each(spark):
    """One plan gives each search's own rows in its order: ids, names, aliases, cities, nulls, blanks."""
    rows = [("p1", "North Clinic", "San Jose", ["Old North", None], 5), ("p2", "south p1 ward", "San", None, 9), ("p3", None, "San Jose West", ["northern"], None), ("P4", "Jose", None, [], 1), ("p5", "x", "", ["y"], 2)]
    df = spark.createDataFrame(rows, "provider string, name string, city string, aliases array<string>, discharges int")
    texts = ["north", " San ", "san jose", "p1", "P4", "o", "or", "zz", "jose", "y"]
    asked = spark.createDataFrame([*enumerate(texts), (99, "  "), (98, None)], "q long, query string")
    got = {}
    for r in rc.name_searches(df, asked).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.provider, r.rank))
    want = {k: [(r.provider, r.rank) for r in rc.name_search(df, t).collect()] for k, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}
