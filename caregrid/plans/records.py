"""Queries over linked records: lookups, code edges, checks of notes, exports, views and answer rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import vocabulary as vo
from ..operators import graph as gr
from ..operators import notes as nt
from ..operators import records as rc
from ..sources import terminology as tm
from .base import table

#: Order of priorities, and the priorities expected of a status.
PRIORITIES = ["3-MEDIUM", "1-URGENT", "2-HIGH", "5-LOW", "4-NOT SPECIFIED"]
EXPECTED = {"F": ["1-URGENT", "2-HIGH"], "O": ["3-MEDIUM", "5-LOW"]}
#: Rules for answers as (kind, value, threshold).
RULES = [("contains", "a", 0.0), ("not_contains", "zzz", 0.0), ("length_gt", "4", 0.0), ("regex", "[a-z]+", 0.0), ("tokens_gt", "1", 0.0), ("fuzzy_match", "Part 1", 0.3), ("starts_with", "part", 0.0), ("ends_with", "1", 0.0), ("unheard_of", "", 0.0)]
#: Fixed value: the cue of a negation.
CUE = "and "


def j1(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return rc.enrich(table(spark, d, "part").select("p_partkey"), lines, "p_partkey", "l_returnflag")


def j3(spark, d):
    codes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return rc.code_edges(codes, table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("src")))


def j4(spark, d):
    edges = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))
    drugs = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("src"))
    return rc.cross_edges(edges, drugs, table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("dst")))


def j10(spark, d):
    """Pairs of a concept and its direct parent that stand in the same note (an order); the derived tree has no parent 0, as in the graph queries."""
    codes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_partkey").alias("child")).distinct()
    up = F.array_distinct(F.array(F.expr("child div 2"), F.expr("child div 3")))
    pairs = codes.select("note", "child", F.explode(up).alias("parent")).filter("parent > 0 AND parent <> child")
    return pairs.join(codes.withColumnRenamed("child", "parent"), ["note", "parent"], "left_semi").select("note", "child", "parent")


def j13(spark, d):
    """The five smallest different codes two steps away; customers without any have an empty list."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rc.first_codes(table(spark, d, "customer"), orders.select(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("code")), "c_custkey")


def j14(spark, d):
    kind = F.when(F.col("s_acctbal") > 5000, "MCC").when(F.col("s_acctbal") > 0, "CC").alias("designation")
    named = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), kind)
    return rc.designated(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), named, "l_suppkey").drop("l_suppkey")


def j16(spark, d):
    rid = F.concat(F.when(F.col("event_id") % 2 == 0, "memory:").otherwise("doc:"), F.col("user_id"))
    return rc.context_links(table(spark, d, "events").select("event_type", rid.alias("rid")), table(spark, d, "customer").select(F.col("c_custkey").alias("card"))).select("event_type", "card")


def _mentions(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(sc.keywords(F.col("text"), 5)).alias("concept"))


def j17(spark, d):
    """An entry (a conversation) is about the concepts that its source cards (the turns) mention."""
    entries = table(spark, d, "conversations").select(F.col("conv_id").alias("entry"), F.col("conv_id"), "turn")
    return rc.inherited(entries, _mentions(spark, d), ["conv_id", "turn"])


def a1(spark, d):
    """Last full name (user turns), first synonym (other turns) as preferred term, else the full name; the number of different synonyms."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("concept_id"), F.col("turn").cast("string").alias("id"), F.md5("text").alias("term"), (F.col("role") == "user").alias("is_fsn"))
    return tm.concept_lookup(rows).select(F.col("concept_id").alias("conv_id"), F.col("fsn").alias("name"), "preferred", F.size(F.array_distinct("synonyms")).alias("synonyms"))


def a2(spark, d):
    """The best entry by order of priority, the first of equals; the number of others."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("rxcui"), F.col("o_orderpriority").alias("tty"), F.format_string("%012d", "o_orderkey").alias("str"))
    return tm.drug_lookup(rows, PRIORITIES).select(F.col("rxcui").alias("o_custkey"), F.col("preferred").cast("long").alias("best"), F.size("synonyms").alias("others"))


def a12(spark, d):
    return rc.counts_by_each(table(spark, d, "orders"), {"o_orderstatus": "layer", "o_orderpriority": "priority"})


def a20(spark, d):
    """Terms that a note both affirms and denies."""
    rows = table(spark, d, "events").select("user_id", F.lower(F.trim("event_type")).alias("term"), (F.col("value") < 50).alias("denied"))
    return rows.groupBy("user_id", "term").agg(F.bool_or("denied").alias("_d"), F.bool_or(~F.col("denied")).alias("_a")).filter("_d AND _a").select("user_id", "term")


def a21(spark, d):
    """Entries whose tag is not among those expected of their category; a category without expectations has no mismatch."""
    sets = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wrong = ~F.array_contains(F.try_element_at(sets, F.col("o_orderstatus")), F.col("o_orderpriority"))
    return table(spark, d, "orders").filter(wrong).select("o_orderkey", F.col("o_orderpriority").alias("tag"))


def a22(spark, d):
    return rc.claim_rollup(table(spark, d, "events"), "user_id", F.col("value") / 100)


def w9(spark, d):
    return rc.substring_lookup(table(spark, d, "part"), "p_name", "1", "p_size", [3, 5]).select("p_partkey", "by_text")


def w10(spark, d):
    """What touches a concept (a customer), newest first: orders, shipped lines, returned lines, events."""
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    back, events = lines.filter("l_returnflag = 'R'"), table(spark, d, "events")
    of_lines = ("o_custkey", "l_orderkey", "l_shipdate")
    return rc.timeline({"order": (o, "o_custkey", "o_orderkey", "o_orderdate"), "line": (lines, *of_lines), "return": (back, *of_lines), "event": (events, "user_id", "event_id", "ts")})


def u5(spark, d):
    """Edges of the provenance view, the lineage view, and of both."""
    e = table(spark, d, "lineitem").select(F.concat_ws(":", "l_returnflag", "l_linestatus").alias("type"))
    provenance, lineage = ["A:F", "R:F"], ["N:O", "N:F"]
    return rc.view_counts(e, {"provenance": provenance, "lineage": lineage, "full": provenance + lineage})


def k5(spark, d):
    """Lines of a CSV file with all fields quoted, nulls as '', newest first."""
    e = table(spark, d, "events").filter("value >= 50").orderBy(F.desc("ts"), F.desc("event_id"))
    return rc.csv_lines(e, ["event_id", "user_id", "event_type", "props"], ["event_id"])


def k6(spark, d):
    """Blocks of a session's Markdown: a head (turn -1) with the number of turns, then a block a turn."""
    return rc.session_markdown(table(spark, d, "conversations")).withColumn("block", F.md5("block"))


def p8(spark, d):
    raw = F.concat(F.lit("<think>"), F.col("role"), F.lit("</think> "), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", sc.split_thinking(raw).alias("s")).select("conv_id", "turn", F.col("s.thinking").alias("thinking"), F.md5("s.answer").alias("answer"))


def p9(spark, d):
    raw = F.concat(F.lit("<think>x</think>\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", sc.strip_wrapper(raw).alias("body"))


def p10(spark, d):
    raw = F.concat(F.lit("Intro\n**Key Points:**\n- "), F.col("p_name"), F.lit("\nno bullet\n* "), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(sc.key_points(raw), "|").alias("points"))


#: Sentences that notes are made of here, one for each part and place.
SAID = [
    ["WBC 15,000 K/uL and glucose of 250 mg/dL", "HbA1c 8.5% today", "no labs"],
    ["denies chest pain", "severe abdominal pain, no fever", "mild HTN, no sob", "chronic cough with fever"],
    ["metformin and aspirin daily", "CT scan of the chest", "appendectomy, then insulin", "heart failure, acute; hemoglobin stable", "paint on the wall"],
]


def _note(spark, d):
    said = [F.element_at(F.array(*map(F.lit, s)), (F.col("p_partkey") % len(s) + 1).cast("int")) for s in SAID]
    return table(spark, d, "part").select("p_partkey", F.concat_ws(". ", "p_name", *said).alias("text"))


def w8b(spark, d):
    """Searches for each nation's name, each fiftieth supplier's id and the letters of each region's name, over all suppliers."""
    n = table(spark, d, "nation")
    rows = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("provider"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.col("s_acctbal").alias("discharges"))
    ids = table(spark, d, "supplier").filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").cast("string").alias("query"))
    asked = n.select(F.col("n_name").alias("query")).unionByName(ids).unionByName(table(spark, d, "region").select(F.substring("r_name", 1, 1).alias("query"))).distinct()
    return rc.name_searches(rows, asked.select(F.col("query").alias("q"), "query")).select("q", "provider", "rank", "place")


def p13(spark, d):
    return nt.dictionary_concepts(_note(spark, d), "p_partkey")


def p14(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.negated(F.col("text"), F.lit("that"), CUE).alias("negated"))


def n10(spark, d):
    """All rules must hold for an answer; a rule of an unknown kind holds."""
    return rc.answer_rules(table(spark, d, "part"), RULES, "p_partkey", "p_name")


def g9(spark, d):
    """Concepts merged by trimmed lower-case name: the last value that is not null."""
    rows = table(spark, d, "events").select(F.lower(F.trim("event_type")).alias("node"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("owner"), F.get_json_object("props", "$.k").alias("k"), "event_id")
    return gr.merge_nodes(rows, "event_id")


def g11(spark, d):
    """A row a concept: parents, first 50 children, number of codes."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")
    up = p.select("node", F.explode(F.array_distinct(F.array(F.expr("node div 2"), F.expr("node div 3")))).alias("parent")).filter("parent > 0")
    first = up.withColumn("_r", F.row_number().over(Window.partitionBy("parent").orderBy("node"))).filter("_r <= 50")
    codes = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count_distinct("l_suppkey").alias("codes"))
    out = p.join(up.groupBy("node").agg(text("parent").alias("parents")), "node", "left").join(first.groupBy(F.col("parent").alias("node")).agg(text("node").alias("children")), "node", "left").join(codes, "node", "left")
    return out.select("node", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("children", F.lit("")).alias("children"), F.coalesce("codes", F.lit(0)).alias("codes"))


def g12(spark, d):
    """Each nation's diagram, read back into labelled nodes."""
    code = F.format_string("flowchart TD\n%%%% note\nn%d[%s] -->|in| r%d{Area}\nr%d --> x", "n_nationkey", "n_name", "n_regionkey", "n_regionkey")
    return gr.diagram_rows(table(spark, d, "nation").select(F.col("n_nationkey").alias("diagram_id"), code.alias("code")))[0]


QUERIES = {
    "j1_enrichment": j1, "j3_code_edges": j3, "j4_cross_edges": j4, "j10_parent_child_pairs": j10, "j13_two_hop_codes": j13, "j14_designation": j14, "j16_context_links": j16, "j17_inheritance": j17,
    "a1_concept_lookup": a1, "a2_best_term": a2, "a12_rule_stats": a12, "a20_negation_conflict": a20, "a21_tag_mismatch": a21, "a22_claim_rollup": a22, "w9_substring_lookup": w9,
    "w10_timeline": w10, "u5_views": u5, "k5_csv_lines": k5, "k6_session_markdown": k6, "p8_reasoning_split": p8, "p9_wrapper_strip": p9, "p10_key_points": p10,
    "p13_dictionary_concepts": p13, "w8_batch_search": w8b, "p14_negation": p14, "n10_answer_rules": n10, "g9_merge": g9, "g11_concept_document": g11, "g12_diagram_rows": g12,
}

_MENTIONS = """m AS (SELECT DISTINCT conv_id, turn, concept FROM (SELECT conv_id, turn, unnest(list_slice(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), 1, 5)) AS concept
  FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN :STOP) AS w FROM conversations)))"""

def _dictionary_sql() -> str:
    """The concepts of the notes above, from the same vocabulary."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    array = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
    words = [(1, k, m, m, "medication") for k, m in enumerate(vo.MEDICATIONS)] + [(2, k, a, x, "condition") for k, (a, x) in enumerate(vo.CONDITION_SHORT.items())]
    terms = [(3, n, n, c) for c, names in vo.NOTE_TERMS.items() for n in names]
    values = lambda rows: ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    lab = q(rf"(?i)\b({'|'.join(vo.LABS)})\s*(?:of\s+)?(\d[\d,]*\.?\d*)\s*({'|'.join(vo.UNITS)})?")
    said = " || '. ' || ".join(["p_name", *[f"{array(s)}[p_partkey % {len(s)} + 1]" for s in SAID]])
    near = f"list_filter({array(vo.QUALIFIERS)}, lambda x: contains(b, x) OR contains(a, x))[1]"
    return rf"""WITH n AS (SELECT p_partkey, {said} AS t FROM part), l AS (SELECT *, lower(t) AS low FROM n),
      w(kind, k, key, term, category) AS (VALUES {values(words)}), s(kind, k, term, category) AS (VALUES {values([(3, k, n, c) for k, (_, n, _, c) in enumerate(terms)])}),
      p(kind, k, key, term) AS (VALUES {values([(4, k, p, x) for k, (p, x) in enumerate(vo.PROCEDURES.items())])}),
      x AS (SELECT p_partkey, 0 AS kind, unnest(range(len(regexp_extract_all(t, {lab})))) AS k, unnest(list_transform(list_zip(regexp_extract_all(t, {lab}, 1), regexp_extract_all(t, {lab}, 2), regexp_extract_all(t, {lab}, 3)),
          lambda z: z[1] || ' ' || z[2] || coalesce(z[3], ''))) AS term, 'lab_value' AS category, false AS negated, NULL AS qualifier FROM l
        UNION ALL SELECT p_partkey, kind, k, term, category, kind = 2 AND regexp_matches(low, '(?:no|denies|without)\s+' || key), NULL FROM l, w WHERE regexp_matches(low, '\b' || key || '\b')
        UNION ALL SELECT p_partkey, kind, k, term, category, regexp_matches(b, {q(vo.NEGATION)}), {near}
          FROM (SELECT *, substring(low, greatest(pos - 25, 1), pos - greatest(pos - 25, 1)) AS b, substring(low, pos, length(term) + 15) AS a FROM (SELECT *, strpos(low, term) AS pos FROM l, s) WHERE pos > 0)
        UNION ALL SELECT p_partkey, kind, k, term, 'procedure', false, NULL FROM l, p WHERE regexp_matches(low, key)),
      f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(trim(term)) ORDER BY kind, k) = 1)
      SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY kind, k)::INT - 1 AS place, term, category, negated, qualifier FROM f"""


ORACLE = {
    "j1_enrichment": "SELECT p_partkey, count(l_orderkey) AS n, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey",
    "j3_code_edges": "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10",
    "j4_cross_edges": "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE c_acctbal > 0 AND p_size > 25",
    "j10_parent_child_pairs": """WITH c AS (SELECT DISTINCT l_orderkey AS note, l_partkey AS code FROM lineitem)
      SELECT DISTINCT a.note, a.code AS child, b.code AS parent FROM c a JOIN c b ON a.note = b.note AND b.code IN (a.code // 2, a.code // 3) AND b.code > 0""",
    "j13_two_hop_codes": """WITH c AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT c_custkey, coalesce(array_to_string(list_slice(list_sort(list(l_partkey) FILTER (l_partkey IS NOT NULL)), 1, 5), ','), '') AS codes FROM customer LEFT JOIN c ON o_custkey = c_custkey GROUP BY c_custkey""",
    "j14_designation": "SELECT l_orderkey, l_linenumber, CASE WHEN s_acctbal > 5000 THEN 'MCC' WHEN s_acctbal > 0 THEN 'CC' ELSE 'NONE' END AS designation FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey",
    "j16_context_links": "SELECT DISTINCT event_type, user_id AS card FROM events JOIN customer ON c_custkey = user_id WHERE event_id % 2 = 0",
    "j17_inheritance": f"WITH {_MENTIONS} SELECT DISTINCT conv_id AS entry, concept FROM m",
    "a1_concept_lookup": """WITH r AS (SELECT conv_id, turn, md5(text) AS term, role = 'user' AS f FROM conversations),
      g AS (SELECT conv_id, arg_max(term, turn) FILTER (f) AS name, arg_min(term, turn) FILTER (NOT f) AS first, count(DISTINCT term) FILTER (NOT f) AS synonyms FROM r GROUP BY conv_id)
      SELECT conv_id, name, coalesce(first, name) AS preferred, synonyms FROM g""",
    "a2_best_term": """WITH r AS (SELECT *, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 4 WHEN '4-NOT SPECIFIED' THEN 5 ELSE 6 END AS p FROM orders)
      SELECT o_custkey, arg_min(o_orderkey, (p, o_orderkey)) AS best, count(*) - 1 AS others FROM r GROUP BY o_custkey""",
    "a12_rule_stats": "SELECT o_orderstatus AS layer, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))",
    "a20_negation_conflict": "SELECT user_id, lower(trim(event_type)) AS term FROM events GROUP BY 1, 2 HAVING bool_or(value < 50) AND bool_or(value >= 50)",
    "a21_tag_mismatch": "SELECT o_orderkey, o_orderpriority AS tag FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'O' AND o_orderpriority NOT IN ('3-MEDIUM', '5-LOW')",
    "a22_claim_rollup": """WITH g AS (SELECT user_id, count(*) FILTER (value >= 50) AS supported, count(*) FILTER (value >= 20 AND value < 50) AS weak, count(*) FILTER (value < 20) AS unsupported, round(avg(value / 100), 6) AS confidence FROM events GROUP BY user_id)
      SELECT *, CASE WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.4 THEN 'Medium' WHEN confidence > 0.1 THEN 'Low' ELSE 'Ungrounded' END AS label, supported || ' of ' || (supported + weak + unsupported) || ' supported' AS detail FROM g""",
    "w9_substring_lookup": "SELECT p_partkey, contains(lower(p_name), '1') AS by_text FROM part WHERE contains(lower(p_name), '1') OR p_size IN (3, 5)",
    "w10_timeline": """SELECT o_custkey AS concept, 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders UNION ALL SELECT user_id, 'event', event_id, ts FROM events
      UNION ALL SELECT o_custkey, unnest(CASE WHEN l_returnflag = 'R' THEN ['line', 'return'] ELSE ['line'] END), l_orderkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "u5_views": """WITH e AS (SELECT l_returnflag || ':' || l_linestatus AS t FROM lineitem) SELECT 'provenance' AS view, count(*) AS n FROM e WHERE t IN ('A:F', 'R:F') HAVING n > 0
      UNION ALL SELECT 'lineage', count(*) AS n FROM e WHERE t IN ('N:O', 'N:F') HAVING n > 0 UNION ALL SELECT 'full', count(*) AS n FROM e WHERE t IN ('A:F', 'R:F', 'N:O', 'N:F') HAVING n > 0""",
    "k5_csv_lines": """SELECT event_id, '"' || event_id || '","' || coalesce(user_id::VARCHAR, '') || '","' || replace(coalesce(event_type, ''), '"', '""') || '","' || replace(coalesce(props, ''), '"', '""') || '"' AS line FROM events WHERE value >= 50""",
    "k6_session_markdown": """SELECT conv_id, -1::BIGINT AS turn, md5('# Session ' || conv_id || chr(10) || chr(10) || count(*) || ' turns') AS block FROM conversations GROUP BY conv_id
      UNION ALL SELECT conv_id, turn, md5('## ' || upper(left(role, 1)) || lower(substring(role, 2)) || chr(10) || chr(10) || coalesce(text, '')) FROM conversations""",
    "p8_reasoning_split": "SELECT conv_id, turn, role AS thinking, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS answer FROM conversations",
    "p9_wrapper_strip": "SELECT event_id, props AS body FROM events",
    "p10_key_points": "SELECT p_partkey, p_name || '|' || p_type AS points FROM part",
    "p13_dictionary_concepts": _dictionary_sql(),
    "w8_batch_search": """WITH r AS (SELECT s_suppkey AS provider, lower(s_name) AS nm, s_name AS name, lower(n_name) AS city, s_acctbal AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      a AS (SELECT n_name AS q FROM nation UNION SELECT s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 50 = 0 UNION SELECT left(r_name, 1) FROM region), j AS (SELECT a.q, lower(trim(a.q)) AS x, r.* FROM a, r),
      h AS (SELECT *, CASE WHEN provider::VARCHAR = x THEN 0 WHEN starts_with(nm, x) OR starts_with(city, x) THEN 1 ELSE 2 END AS rank FROM j WHERE provider::VARCHAR = x OR contains(nm, x) OR city = x OR starts_with(city, x || ' '))
      SELECT q, provider, rank, row_number() OVER (PARTITION BY q ORDER BY rank, d DESC NULLS LAST, name, provider) AS place FROM h QUALIFY place <= 20""",
    "p14_negation": "SELECT doc_id, regexp_matches(lower(text), '(?s)and .{0,76}that') AS negated FROM documents",
    "n10_answer_rules": """WITH r AS (SELECT p_partkey, [contains(lower(p_name), 'a'), NOT contains(lower(p_name), 'zzz'), length(p_name) > 4, regexp_matches(p_name, '[a-z]+'), len(regexp_split_to_array(trim(p_name), '\\s+')) > 1,
        1 - levenshtein(lower(p_name), 'part 1') / greatest(length(p_name), 6) >= 0.3, starts_with(lower(trim(p_name)), 'part'), ends_with(trim(p_name), '1')] AS held FROM part)
      SELECT p_partkey, list_bool_and(held) AS passed, len(list_filter(held, lambda x: NOT x)) AS failed FROM r""",
    "g9_merge": "SELECT lower(trim(event_type)) AS node, arg_max(user_id, event_id) FILTER (event_id % 3 <> 0) AS owner, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM events GROUP BY 1",
    "g11_concept_document": """WITH t AS (SELECT DISTINCT node, parent FROM (SELECT p_partkey AS node, p_partkey // 2 AS parent FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE parent > 0)
      SELECT p_partkey AS node, coalesce((SELECT string_agg(parent::VARCHAR, ',' ORDER BY parent) FROM t WHERE t.node = p_partkey), '') AS parents,
        coalesce((SELECT string_agg(node::VARCHAR, ',' ORDER BY node) FROM t WHERE t.parent = p_partkey), '') AS children, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS codes FROM part""",
    "g12_diagram_rows": """SELECT n_nationkey AS diagram_id, 'n' || n_nationkey AS id, n_name AS label FROM nation UNION ALL SELECT n_nationkey, 'r' || n_regionkey, 'Area' FROM nation UNION ALL SELECT n_nationkey, 'x', 'x' FROM nation""",
}
