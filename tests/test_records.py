"""Operators over linked records, on small tables with their odd cases."""

from caregrid.operators import graph as gr
from caregrid.operators import notes as nt
from caregrid.operators import records as rc
from pyspark.sql import functions as F


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_name_search(spark):
    table = spark.createDataFrame(
        [("H1", "Boston Medical", "Boston", "MA", ["BMC"], 50), ("H2", "Mercy", "Boston Heights", "OH", None, 90), ("boston", "Other", "Reno", "NV", [], None), ("H4", "New Boston Clinic", "Bostonia", "CA", ["x"], 70), ("H5", "St. Jude", "Bostonville", "TX", ["Old Boston"], 10), ("H6", None, None, "TX", None, 5)],
        "provider string, name string, city string, state string, aliases array<string>, discharges int",
    )
    assert rows(rc.name_search(table, " Boston "), "provider", "rank") == [("boston", 0), ("H2", 1), ("H4", 1), ("H1", 1), ("H5", 1)]
    assert rows(rc.name_search(table, "bmc"), "provider") == [("H1",)] and rows(rc.name_search(table, "boston", state="OH"), "provider") == [("H2",)]


def test_lookups(spark):
    table = spark.createDataFrame([("Ab", "Fever and chills", "I10", "high"), ("ab", "none", "E11", "low"), ("c", None, "I10", "low")], "rule string, text string, code string, priority string")
    assert rows(rc.substring_lookup(table, "text", "FEVER"), "rule", "by_text") == [("Ab", True)]
    assert rows(rc.substring_lookup(table, "text", code="code", codes=["I10"], priority=("priority", "low")), "rule") == [("c",)]
    assert rows(rc.by_id(table, "rule", "ab"), "rule") == [("ab",)] and sorted(rows(rc.by_id(table, "rule", "AB"), "rule")) == [("Ab",), ("ab",)]


def test_cards(spark):
    cards = spark.createDataFrame([(1, "The Text", None, "pending", "a"), (2, None, "the reason", "approved", "a"), (3, "plain", "x", "approved", "b")], "card long, text string, reason string, approval string, category string")
    assert rows(rc.card_filter(cards, ["card"], search="THE"), "card") == [(2,), (1,)]
    assert rows(rc.card_filter(cards, ["card"], approval="approved", category="b"), "card") == [(3,)]
    said = spark.createDataFrame([(1, "approve", 1), (1, "reject", 2), (2, "reject", 1), (2, "approve", 2)], "card long, what string, at int")
    told, entries = rc.promoted(cards, rc.first_decisions(said, "card", "what", ["at"]), "approve")
    assert sorted(rows(told, "card", "status")) == [(1, "approved"), (2, "rejected"), (3, "pending")] and rows(entries, "card") == [(1,)]


def test_answer_rules(spark):
    answers = spark.createDataFrame([(1, " Yes, it is DRG 470."), (2, None)], "id int, a string")
    of = lambda *rule: rc.answer_rules(answers, [rule], "id", "a").orderBy("id").collect()[0].passed
    assert of("starts_with", "yes", 0) and of("ends_with", "470.", 0) and not of("starts_with", "it", 0) and of("no such kind", "", 0)
    assert of("length_gt", "5", 0) and not of("length_gt", "500", 0) and of("regex", "[0-9]{3}", 0) and not of("tokens_gt", "9", 0)


def test_exports(spark):
    docs = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "z"), (5, None)], "id int, kind string")
    got = rc.category_markdown(docs, "kind", "id", F.concat(F.lit("- "), F.col("id")), ["a", "none", "b"]).orderBy("place", F.asc_nulls_first("id"))
    assert [r.line for r in got.collect()] == ["## a", "- 2", "## b", "- 1", "- 3"]
    made, counts = rc.backfill(docs, docs.filter("id < 3"), "id")
    assert sorted(rows(made, "id")) == [(3,), (4,), (5,)] and rows(counts, "created", "skipped") == [(3, 2)]
    odd = spark.createDataFrame([(1, 'say "x", y', None)], "id int, a string, b string")
    assert rows(rc.csv_lines(odd, ["id", "a", "b"], ["id"]), "line") == [('"1","say ""x"", y",""',)]


def test_scoped_graph(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("a", "e", "y"), ("b", "e", "x")], "src string, dst string, type string")
    anchors = spark.createDataFrame([("a",)], "node string")
    nodes, inside = gr.scoped(edges, anchors, 2, ["x"], n=3)
    assert sorted(rows(nodes, "node", "distance")) == [("b", 1), ("c", 2), ("e", 2)] and sorted(rows(inside, "src", "dst")) == [("a", "b"), ("b", "c"), ("b", "e")]
    labels = spark.createDataFrame([("c", "doc"), ("e", "card"), ("b", "term")], "node string, label string")
    assert sorted(rows(gr.artifact_lineage(edges, anchors, labels, ["doc", "card"], 3), "node", "label", "place")) == [("c", "doc", 2), ("e", "card", 1)]


def test_dictionary_concepts(spark):
    note = "WBC of 15,000 K/uL; a1c 8.5%. Denies CP. No fever, severe abdominal pain. On Metformin. CT scan of the chest, x-ray. Ha ha. paint"
    notes = spark.createDataFrame([("n", note), ("none", None), ("empty", "")], "note string, text string")
    got = {r.term: (r.category, r.negated, r.qualifier) for r in nt.dictionary_concepts(notes).filter("note = 'n'").collect()}
    assert got["WBC 15,000K/uL"] == ("lab_value", False, None) and got["a1c 8.5%"][0] == "lab_value" and got["metformin"][0] == "medication"
    assert got["chest pain"][:2] == ("condition", True) and got["headache"] == ("condition", False, None) and got["fever"][:2] == ("symptom", True)
    assert got["abdominal pain"] == ("symptom", True, "severe") and got["CT scan"][0] == got["X-ray"][0] == "procedure" and got["chest"][0] == "body_site"
    assert nt.dictionary_concepts(notes).select("note").distinct().count() == 1 and nt.dictionary_concepts(notes, most=3).count() == 3
