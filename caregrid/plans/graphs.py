"""Graph and log queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import graph as gr
from ..operators import records as rc
from .base import table


def _tree(spark, d):
    """Parts as concepts: each has up to two parents."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("child"))
    up = p.select("child", F.expr("child div 2").alias("parent")).unionByName(p.select("child", F.expr("child div 3").alias("parent")))
    return up.filter("parent > 0").distinct()


def g1(spark, d):
    return gr.ancestors(_tree(spark, d), 4)


def g2(spark, d):
    return gr.descendants(_tree(spark, d), 3)


def g3(spark, d):
    return gr.ancestors(_tree(spark, d), 2).select("node", "ancestor").distinct()


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_orderkey"), "l_linenumber")


def g4(spark, d):
    seeds = table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"))
    return gr.neighborhood(_edges(spark, d), seeds, 2)


def g5(spark, d):
    """Lines between larger parts and suppliers with money, by type."""
    parts = table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"))
    sups = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return gr.induced(_edges(spark, d), parts.unionByName(sups)).groupBy("type").agg(F.count("*").alias("n"))


def j2(spark, d):
    e = _edges(spark, d).withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber")).drop("l_linenumber")
    parts = table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"))
    sups = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return gr.checked_edges(e, parts, sups, "ord")


def a17(spark, d):
    return gr.size_by_type(_edges(spark, d))


def a17_full(spark, d):
    """Parts and suppliers, line items as edges of which those with flag N are membership, vectors by label."""
    nodes = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    return gr.graph_size(nodes, _edges(spark, d), ["N"], table(spark, d, "embeddings").select(F.col("label").cast("string").alias("source")))


def p18_rejects(spark, d):
    """Events whose type is no known one, with the reason; each seventh type has a blank in it."""
    kind = F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit(" x"))).otherwise(F.concat(F.lit(" "), "event_type"))
    return gr.typed_edges(table(spark, d, "events").select("event_id", kind.alias("type")), ["CLICK", "VIEW"])[1]


def _mentions(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("artifact"), F.explode(sc.keywords(F.col("text"), 5)).alias("concept"))


def a18(spark, d):
    m = _mentions(spark, d)
    return gr.degree_ranking(m.select(F.col("concept").alias("node")).distinct(), m.select(F.col("artifact").alias("src"), F.col("concept").alias("dst")), 20)


def a19(spark, d):
    return gr.cooccurrence(_mentions(spark, d), 50)


def g13(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("graph"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.col("n_name").alias("name"), F.lit("Concept").alias("label"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("graph"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.col("r_name").alias("name"), F.lit("Diagram").alias("label"))
    e = n.select("graph", F.col("node").alias("src"), F.concat(F.lit("r"), F.col("graph")).alias("dst"), F.lit("IS_IN").alias("type"))
    return gr.diagram_text(n.unionByName(r), e)


def a11(spark, d):
    return rc.profile(table(spark, d, "events"), "event_type", "ts")


def _feedback(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("value") >= 50, "positive").otherwise("negative").alias("rating"), "value")


def a13(spark, d):
    return rc.rating_totals(_feedback(spark, d))


def a14(spark, d):
    calls = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return rc.rating_averages(_feedback(spark, d), calls, "user_id", "value", "c_acctbal")


def a15(spark, d):
    return rc.daily_ratings(_feedback(spark, d), table(spark, d, "events").agg(F.max("ts").alias("now")))


def a16(spark, d):
    return rc.monthly_counts(table(spark, d, "orders"), "o_orderdate", "o_orderpriority")


def a23(spark, d):
    return rc.diversity(table(spark, d, "documents"), "lang", "source", {"src1": "one", "src2": "two", "src3": "three"})


def j15(spark, d):
    calls = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return rc.feedback_with_call(_feedback(spark, d), calls, "user_id", "c_name", "negative")


def w5(spark, d):
    return rc.turn_history(table(spark, d, "conversations"))


def w6(spark, d):
    return rc.session_list(table(spark, d, "conversations"))


def w7(spark, d):
    return rc.newest_first(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


def w3(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place")).filter("place <= 2")


def k7(spark, d):
    """Documents by language as lines of a Markdown file, languages in a fixed order."""
    line = F.concat(F.lit("- "), F.col("source"), F.lit(" #"), F.col("doc_id"))
    return rc.category_markdown(table(spark, d, "documents"), "lang", "doc_id", line, ["en", "fr", "de", "es", "it"]).select("place", "id", "line")


def n12(spark, d):
    """Decisions on cards (customers): the first one counts; the state it gives the card."""
    firsts = rc.first_decisions(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
    cards = table(spark, d, "customer").select(F.col("c_custkey").alias("card"))
    return rc.promoted(cards, firsts, "purchase")[0].select("card", "decision", "status")


QUERIES = {
    "g1_ancestors": g1, "g2_descendants": g2, "g3_ancestor_set": g3, "g4_neighborhood": g4, "g5_induced": g5, "j2_checked_edges": j2, "a17_graph_size": a17, "a17_full_size": a17_full, "p18_rejects": p18_rejects, "a18_degree_ranking": a18,
    "a19_cooccurrence": a19, "g13_diagram_text": g13, "a11_profile": a11, "a13_feedback_totals": a13, "a14_rating_averages": a14, "a15_daily_trend": a15, "a16_monthly_trend": a16,
    "a23_diversity": a23, "j15_feedback_calls": j15, "w3_cap_per_group": w3, "w5_turn_history": w5, "w6_session_list": w6, "w7_newest_first": w7, "k7_markdown_by_category": k7, "n12_first_decision": n12,
}

_TREE = "t AS (SELECT DISTINCT child, parent FROM (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE parent > 0)"
_UP = f"WITH RECURSIVE {_TREE}, a AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM t UNION SELECT a.node, t.parent, distance + 1 FROM a JOIN t ON t.child = a.ancestor WHERE distance < %d)"
_EDGES = "e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS type, l_orderkey, l_linenumber FROM lineitem)"
_KEYS = """m AS (SELECT DISTINCT artifact, concept FROM (SELECT artifact, unnest(list_slice(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), 1, 5)) AS concept
  FROM (SELECT conv_id || ':' || turn AS artifact, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN :STOP) AS w FROM conversations)))"""

_RATING = "f AS (SELECT *, CASE WHEN value >= 50 THEN 'positive' ELSE 'negative' END AS rating FROM events)"

ORACLE = {
    "g1_ancestors": (_UP % 4) + " SELECT node, ancestor, min(distance) AS distance FROM a GROUP BY ALL",
    "g2_descendants": (_UP % 3) + " SELECT ancestor AS node, node AS descendant, min(distance) AS distance FROM a GROUP BY ALL",
    "g3_ancestor_set": (_UP % 2) + " SELECT DISTINCT node, ancestor FROM a",
    "g4_neighborhood": f"""WITH {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT 'p' || p_partkey AS seed FROM part WHERE p_partkey % 50 = 0),
      h AS (SELECT seed, dst AS node, 1 AS distance FROM s JOIN b ON seed = src UNION ALL SELECT seed, b2.dst, 2 FROM s JOIN b b1 ON seed = b1.src JOIN b b2 ON b1.dst = b2.src)
      SELECT seed, node, min(distance) AS distance FROM h WHERE node <> seed GROUP BY seed, node""",
    "g5_induced": "SELECT l_returnflag AS type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size > 10 AND s_acctbal > 0 GROUP BY 1",
    "j2_checked_edges": f"""WITH {_EDGES} SELECT src, dst, type, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey, max(l_orderkey * 10 + l_linenumber) AS ord FROM e
      WHERE src IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10) AND dst IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY src, dst, type""",
    "a17_full_size": f"""WITH {_EDGES} SELECT 'nodes' AS what, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'edges', count(*) FROM e
      UNION ALL SELECT 'relations', count(*) FROM e WHERE type <> 'N' UNION ALL SELECT 'vectors:' || label, count(*) FROM embeddings GROUP BY label""",
    "p18_rejects": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_type || ' x' ELSE ' ' || event_type END AS type, CASE WHEN event_id % 7 = 0 THEN 'malformed' ELSE 'unknown' END AS reason
      FROM events WHERE event_id % 7 = 0 OR upper(event_type) NOT IN ('CLICK', 'VIEW')""",
    "a17_graph_size": f"WITH {_EDGES} SELECT 'edges:' || type AS what, count(*) AS n FROM e GROUP BY type UNION ALL SELECT 'nodes', count(DISTINCT x) FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e)",
    "a18_degree_ranking": f"WITH {_KEYS} SELECT concept AS node, count(*) AS degree FROM m GROUP BY concept ORDER BY degree DESC, node LIMIT 20",
    "a19_cooccurrence": f"WITH {_KEYS} SELECT a.concept AS a, b.concept AS b, count(*) AS artifacts FROM m a JOIN m b ON a.artifact = b.artifact AND a.concept < b.concept GROUP BY ALL ORDER BY artifacts DESC, a, b LIMIT 50",
    "g13_diagram_text": """WITH i AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY node) AS k FROM (SELECT n_regionkey AS graph, 'n' || n_nationkey AS node, '[' || n_name || ']' AS box FROM nation
        UNION ALL SELECT r_regionkey, 'r' || r_regionkey, '{' || r_name || '}' FROM region)),
      b AS (SELECT graph, string_agg('    N' || k || box, chr(10) ORDER BY k) AS boxes, max(k) FILTER (node[1] = 'r') AS root FROM i GROUP BY graph),
      l AS (SELECT i.graph, string_agg('    N' || k || ' -->|is in| N' || root, chr(10) ORDER BY k) AS links FROM i JOIN b ON i.graph = b.graph WHERE node[1] = 'n' GROUP BY i.graph)
      SELECT b.graph, concat_ws(chr(10), 'flowchart TD', boxes, links) AS code FROM b LEFT JOIN l ON b.graph = l.graph""",
    "a11_profile": "SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type",
    "a13_feedback_totals": f"WITH {_RATING} SELECT count(*) AS total, count(*) FILTER (rating = 'positive') AS positive, count(*) FILTER (rating = 'negative') AS negative, round(count(*) FILTER (rating = 'positive') / count(*), 3) AS rate FROM f",
    "a14_rating_averages": f"WITH {_RATING} SELECT rating, round(avg(value), 6) AS grounding, floor(avg(c_acctbal))::INT AS duration FROM f JOIN customer ON user_id = c_custkey GROUP BY rating",
    "a15_daily_trend": f"WITH {_RATING} SELECT ts::DATE AS day, count(*) FILTER (rating = 'positive') AS positive, count(*) FILTER (rating = 'negative') AS negative FROM f WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1",
    "a16_monthly_trend": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY ALL",
    "a23_diversity": """SELECT lang, round(least(count(DISTINCT CASE WHEN starts_with(source, 'src1') THEN 1 WHEN starts_with(source, 'src2') THEN 2 WHEN starts_with(source, 'src3') THEN 3 ELSE 4 END) / 3, 1.0), 6) AS diversity FROM documents GROUP BY lang""",
    "j15_feedback_calls": f"WITH {_RATING} SELECT event_id, ts, left(c_name, 80) AS prompt FROM f LEFT JOIN customer ON user_id = c_custkey WHERE rating = 'negative' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "w3_cap_per_group": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem QUALIFY place <= 2",
    "w5_turn_history": "SELECT conv_id, string_agg(role || ':' || left(sha256(text), 8), ',' ORDER BY turn) AS history FROM conversations GROUP BY conv_id",
    "w6_session_list": "SELECT conv_id, count(*) AS messages, left(arg_min(text, turn), 60) AS preview FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 50",
    "w7_newest_first": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "k7_markdown_by_category": """SELECT list_position(['en', 'fr', 'de', 'es', 'it'], lang) AS place, doc_id AS id, '- ' || source || ' #' || doc_id AS line FROM documents WHERE lang IN ('en', 'fr', 'de', 'es', 'it')
      UNION ALL SELECT DISTINCT list_position(['en', 'fr', 'de', 'es', 'it'], lang), NULL, '## ' || lang FROM documents WHERE lang IN ('en', 'fr', 'de', 'es', 'it')""",
    "n12_first_decision": """SELECT c_custkey AS card, decision, CASE WHEN decision IS NULL THEN 'pending' WHEN decision = 'purchase' THEN 'approved' ELSE 'rejected' END AS status
      FROM customer LEFT JOIN (SELECT user_id, arg_min(event_type, (ts, event_id)) AS decision FROM events GROUP BY user_id) ON user_id = c_custkey""",
}
