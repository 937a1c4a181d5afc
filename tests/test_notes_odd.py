"""Empty and null inputs of the note checks and text vectors."""

from caregrid.operators import notes as nt
from caregrid.operators import retrieval as rt

CONCEPTS = "note long, line long, term string, category string, negated boolean, qualifier string, code string, mapped_term string, confidence double, tag string"


def test_vectors(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a ! b"), (4, "same same"), (5, "same")], "id long, text string")
    got = {r.id: r.vec for r in rt.embed(docs, 8).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(len(v) == 8 for v in got.values())
    assert not any(got[1]) and not any(got[2]) and not any(got[3])
    assert got[4] == got[5] and sum(got[4]) == 1.0


def test_checks_of_empty_notes(spark):
    expected = spark.createDataFrame([], "code string, kind string, priority string, target string, target_term string, synonyms array<string>")
    parents = spark.createDataFrame([], "child string, parent string")
    none = spark.createDataFrame([], CONCEPTS)
    scores, missing = nt.coverage(none, expected, ["condition"])
    assert scores.count() == missing.count() == 0
    odd = spark.createDataFrame([(1, 1, None, "condition", False, None, "c", None, 0.9, None), (2, 1, "x", "other", False, None, None, None, None, "t")], CONCEPTS)
    scores, missing = nt.coverage(odd, expected, ["condition"])
    assert {tuple(r) for r in scores.collect()} == {(1, 1.0, 1), (2, 1.0, 0)} and missing.count() == 0
    flags, verdicts = nt.consistency(odd, parents, {"condition": ["disorder"]})
    assert flags.count() == 0 and all(r.consistent for r in verdicts.collect())


def test_claims_without_evidence(spark):
    claims = spark.createDataFrame([(1,), (2,)], "q long")
    hits = spark.createDataFrame([(2, 7, 3.0), (2, 8, 0.1)], "q long, id long, score double")
    mentions = spark.createDataFrame([(2, "a")], "q long, concept string")
    nodes = spark.createDataFrame([("a",)], "name string")
    got = {r.q: (r.evidence, r.found, r.supported, r.confidence) for r in nt.validated_claims(claims, hits, mentions, nodes).collect()}
    assert got == {1: (0, 0, False, 0.1), 2: (1, 1, True, 1.0)}


def test_checks_of_a_report_are_written_one_by_one(spark):
    """The report joins the checks' written rows, so that no check's shuffles are there with another's."""
    from caregrid.plans import notes as plans

    report = plans.n5(spark, "/root/testdata/sf0.001")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "p_name" not in plan
    assert report.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
