"""Queries of scans, lineage, load statistics and JSON migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import migration as mg
from ..operators import scans as sn
from ..operators.store import new_path
from .base import table

#: Packs of patterns over the texts, and parts of names that make no worker.
PACKS = [
    sn.Pack("north", {"german": [" und ", " der "], "absent": ["zzzzqq"]}, ["de"], [(" und ", "german"), (" zu ", "absent")], ["absent"]),
    sn.Pack("south", {"spanish": [" que "], "french": [" pour "], "german": ["never"]}, ["es", "fr"], [(" que ", "spanish"), (" pour ", "french")], ["spanish", "french"]),
    sn.Pack("rest", {"english": [" the "]}, ["src"], [(" the ", "english"), ("zu", "german")]),
]
EXCLUDED = ["_7", "src9"]


def _files(spark, d):
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.concat_ws("_", "source", "lang", F.col("doc_id") % 40), F.lit(".py"))
    return table(spark, d, "documents").select(path.alias("path"), F.replace("text", F.lit("\n"), F.lit("\nimport ")).alias("text"))


def n11(spark, d):
    return sn.find_systems(_files(spark, d), PACKS)


def n11_workers(spark, d):
    files = _files(spark, d)
    return sn.find_workers(files, sn.find_systems(files, PACKS), PACKS, EXCLUDED)


def n11_flows(spark, d):
    files = _files(spark, d)
    systems = sn.find_systems(files, PACKS)
    return sn.find_flows(files, sn.find_workers(files, systems, PACKS, EXCLUDED), systems, PACKS)


def _lineage(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "text")
    cards = table(spark, d, "documents").select(F.col("doc_id").alias("card"), (F.col("doc_id") % 50).alias("session"), "text")
    rid = F.concat(F.when(F.col("event_id") % 2 == 0, "memory:").otherwise("doc:"), (F.col("event_id") % 400).cast("string"))
    used = table(spark, d, "events").select(F.col("user_id").alias("session"), rid.alias("rid"))
    diagrams = table(spark, d, "nation").select(F.col("n_nationkey").alias("diagram"), F.col("n_regionkey").alias("session"))
    entries = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("entry"), F.col("doc_id").alias("card"))
    return sn.lineage(turns, cards, used, diagrams, entries)


def g10(spark, d):
    return _lineage(spark, d)[1]


def g10_nodes(spark, d):
    return _lineage(spark, d)[0].groupBy("label").agg(F.count("*").alias("n"))


def k8(spark, d):
    lines = table(spark, d, "lineitem")
    return sn.phase_stats({"concepts": table(spark, d, "part"), "edges": lines.select("l_partkey", "l_suppkey").distinct(), "none": lines.filter("l_quantity < 0")})


def s21(spark, d):
    """A third of the events are in the new store already; the others' times are written with an offset of two hours."""
    e = table(spark, d, "events")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    body = F.to_json(F.struct(F.col("user_id").alias("user"), at.alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    rows = e.select("event_id", F.when(F.col("event_id") % 11 != 0, body).otherwise("{broken").alias("body"))
    return sn.migrated(rows, e.filter("event_id % 3 = 0"), "event_id", "body", "user long, at string, k int", ["at"])


def n11_omitted(spark, d):
    """A scan by the last pack only: what the others would have found."""
    return sn.omitted_packs(_files(spark, d), PACKS, ["rest"]).select("pack", F.array_join("systems", ",").alias("systems"))


def a26_rules(spark, d):
    """Documents as files of some folders and names."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return sn.census(table(spark, d, "documents").select(F.concat_ws("/", pick(FOLDERS), "source", "doc_id", pick(NAMES)).alias("path")))


def s21_tables(spark, d):
    """Three tables are moved twice; the second run finds every row in place."""
    json = lambda t, key, *cs: table(spark, d, t).select(F.concat_ws(":", *key).alias("key"), F.to_json(F.struct(*cs)).alias("body"))
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("at")
    moves = {
        "events": mg.Move(json("events", ["event_id"], "user_id", at), "key", "body", "user_id long, at string", ["at"]),
        "turns": mg.Move(json("conversations", ["conv_id", "turn"], "role", "text"), "key", "body", "role string, text string"),
        "labels": mg.Move(json("labels", ["doc_id"], "quality"), "key", "body", "quality int"),
    }
    job = mg.Migration(spark, new_path(spark, "migration"))
    job.run(moves)
    return job.run(moves)


def g11_full(spark, d):
    """Parts as concepts below their halves and thirds, suppliers that they share as relationships, line items as codes."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("term"), F.col("p_type").alias("tag"))
    up = p.select(F.col("node").alias("child"), F.explode(F.array(F.expr("node div 2"), F.expr("node div 3"))).alias("parent")).filter("parent > 0")
    beside = p.select(F.col("node").alias("src"), F.col("tag").alias("type"), F.expr("node div 5").alias("dst"), F.lit(0).alias("grp"))
    codes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("code"), F.col("l_linenumber").alias("grp"), F.col("l_orderkey").alias("priority"), F.col("l_returnflag").alias("advice"))
    doc = gr.concept_document(p, up, beside, codes)
    text = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    end = lambda x: F.concat_ws(":", x["end"], x["term"])
    return doc.select("node", text("parents", end), text("children", end), text("relationships", lambda x: F.concat_ws(":", x["type"], x["end"])), F.md5(text("codes", lambda x: F.concat_ws(":", x["grp"], x["priority"], x["code"], x["advice"]))).alias("codes"))


def g11_drug(spark, d):
    """Suppliers as drugs that stand beside those of the same order, parts as the concepts they stand for."""
    drugs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("term"), F.col("s_nationkey").alias("kind"))
    lines = table(spark, d, "lineitem")
    links = lines.select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("type"), F.expr("l_partkey % 40 + 1").alias("dst"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("term"), F.col("p_type").alias("tag"))
    doc = gr.drug_document(drugs, links, lines.select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("concept")), parts)
    text = lambda c, f: F.md5(F.array_join(F.transform(c, f), ",")).alias(c)
    return doc.select("node", text("relationships", lambda x: F.concat_ws(":", x["type"], x["end"], x["term"], x["kind"])), text("crossrefs", lambda x: F.concat_ws(":", x["concept"], x["term"], x["tag"])))


#: Folders and names of the files above.
FOLDERS, NAMES = ["src", ".git", "vendor", "lib"], ["a.PY", "Dockerfile", "README", ".bashrc", "x.tar.gz", "Makefile", "b."]

QUERIES = {"n11_systems": n11, "n11_workers": n11_workers, "n11_flows": n11_flows, "g10_lineage": g10, "g10_nodes": g10_nodes, "k8_phase_stats": k8, "s21_json_migration": s21, "n11_omitted": n11_omitted, "a26_census_rules": a26_rules, "s21_verified_migration": s21_tables, "g11_full_document": g11_full, "g11_drug_document": g11_drug}

_FILES = "f AS (SELECT 'src/' || source || '/' || source || '_' || lang || '_' || doc_id % 40 || '.py' AS path, source || '_' || lang || '_' || doc_id % 40 AS stem, replace(text, chr(10), chr(10) || 'import ') AS text FROM documents)"
_SYSTEMS = """s AS (SELECT * FROM (SELECT 'north' AS pack, 'german' AS system, count(*) FILTER (regexp_matches(text, ' (und|der) ')) AS files FROM f UNION ALL SELECT 'north', 'absent', count(*) FILTER (contains(text, 'zzzzqq')) FROM f
  UNION ALL SELECT 'south', 'spanish', count(*) FILTER (regexp_matches(text, ' que ')) FROM f UNION ALL SELECT 'south', 'french', count(*) FILTER (regexp_matches(text, ' pour ')) FROM f
  UNION ALL SELECT 'rest', 'english', count(*) FILTER (regexp_matches(text, ' the ')) FROM f) WHERE files > 0)"""
_WORKERS = """w AS (SELECT stem AS worker, min(path) AS path, CASE WHEN (contains(stem, 'es') OR contains(stem, 'fr')) AND EXISTS (FROM s WHERE system IN ('spanish', 'french')) THEN 'south' ELSE 'rest' END AS pack FROM f
  WHERE NOT contains(stem, '_7') AND NOT contains(stem, 'src9') AND contains(stem, 'src') GROUP BY stem)"""
_KEYS = "(SELECT {id}, unnest(list_slice(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), 1, {n})) AS concept FROM (SELECT {id}, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: x NOT IN :STOP) AS w FROM {table}))"
_LINEAGE = f"""ds AS (SELECT DISTINCT * FROM {_KEYS.format(id='conv_id', n=3, table='conversations')}), mn AS (SELECT DISTINCT * FROM {_KEYS.format(id='doc_id', n=5, table='documents')}),
  n AS (SELECT DISTINCT 'session:' || conv_id AS id, 'session' AS label FROM conversations UNION SELECT 'card:' || doc_id, 'card' FROM documents UNION SELECT 'diagram:' || n_nationkey, 'diagram' FROM nation
    UNION SELECT 'entry:' || doc_id, 'entry' FROM labels WHERE quality = 1 UNION SELECT 'concept:' || concept, 'concept' FROM ds UNION SELECT 'concept:' || concept, 'concept' FROM mn),
  e AS (SELECT 'session:' || conv_id AS src, 'concept:' || concept AS dst, 'DISCUSSES' AS type FROM ds UNION SELECT 'card:' || doc_id, 'concept:' || concept, 'MENTIONS' FROM mn
    UNION SELECT 'entry:' || doc_id, 'concept:' || concept, 'ABOUT' FROM mn JOIN labels USING (doc_id) WHERE quality = 1 UNION SELECT 'entry:' || doc_id, 'card:' || doc_id, 'CURATED_FROM' FROM labels WHERE quality = 1
    UNION SELECT 'session:' || user_id, 'card:' || event_id % 400, 'USED_CONTEXT' FROM events WHERE event_id % 2 = 0 UNION SELECT 'session:' || doc_id % 50, 'card:' || doc_id, 'PROPOSED' FROM documents
    UNION SELECT 'session:' || n_regionkey, 'diagram:' || n_nationkey, 'PRODUCED' FROM nation)"""

ORACLE = {
    "n11_systems": f"WITH {_FILES}, {_SYSTEMS} SELECT * FROM s",
    "n11_workers": f"WITH {_FILES}, {_SYSTEMS}, {_WORKERS} SELECT worker, pack, path FROM w",
    "n11_flows": f"""WITH {_FILES}, {_SYSTEMS}, {_WORKERS}, l AS (SELECT DISTINCT worker, pack, line FROM (SELECT worker, pack, trim(unnest(string_split(text, chr(10)))) AS line FROM w JOIN f USING (path)) WHERE regexp_matches(line, '^(from|import) ')),
      p(pack, pattern, system) AS (VALUES ('south', ' que ', 'spanish'), ('south', ' pour ', 'french'), ('rest', ' the ', 'english'), ('rest', 'zu', 'german'))
      SELECT DISTINCT worker, system FROM l JOIN p USING (pack) WHERE regexp_matches(line, pattern) AND system IN (SELECT system FROM s)""",
    "g10_lineage": f"WITH {_LINEAGE} SELECT * FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)",
    "g10_nodes": f"WITH {_LINEAGE} SELECT label, count(*) AS n FROM n GROUP BY label",
    "k8_phase_stats": """SELECT phase, rows, CASE WHEN rows > 0 THEN 'complete' ELSE 'empty' END AS status FROM (SELECT 'concepts' AS phase, count(*) AS rows FROM part
      UNION ALL SELECT 'edges', count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem UNION ALL SELECT 'none', count(*) FROM lineitem WHERE l_quantity < 0)""",
    "s21_json_migration": """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user, CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS "at",
      CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k')::INT END AS k FROM events WHERE event_id % 3 <> 0""",
    "n11_omitted": f"""WITH {_FILES} SELECT pack, string_agg(system, ',' ORDER BY k) AS systems FROM (SELECT 'north' AS pack, 1 AS k, 'german' AS system, bool_or(regexp_matches(text, ' (und|der) ')) AS hit FROM f
      UNION ALL SELECT 'north', 2, 'absent', bool_or(contains(text, 'zzzzqq')) FROM f UNION ALL SELECT 'south', 1, 'spanish', bool_or(contains(text, ' que ')) FROM f
      UNION ALL SELECT 'south', 2, 'french', bool_or(contains(text, ' pour ')) FROM f UNION ALL SELECT 'south', 3, 'german', bool_or(contains(text, 'never')) FROM f) WHERE hit GROUP BY pack""",
    "a26_census_rules": """WITH f AS (SELECT ['src', '.git', 'vendor', 'lib'][doc_id % 4 + 1] AS dir, lower(['a.PY', 'Dockerfile', 'README', '.bashrc', 'x.tar.gz', 'Makefile', 'b.'][doc_id % 7 + 1]) AS name FROM documents)
      SELECT CASE WHEN name IN ('dockerfile', 'makefile') THEN name ELSE string_split(name, '.')[-1] END AS ext, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total, false AS truncated
      FROM f WHERE dir NOT IN ('.git', 'vendor') AND name <> 'readme' GROUP BY 1""",
    "s21_verified_migration": """SELECT name, n AS held, 0::BIGINT AS added, n AS expected, true AS agreed FROM (SELECT 'events' AS name, count(*) AS n FROM events
      UNION ALL SELECT 'turns', count(*) FROM conversations UNION ALL SELECT 'labels', count(*) FROM labels)""",
    "g11_full_document": """WITH p AS (SELECT p_partkey AS node, p_name AS term, p_type AS tag FROM part), u AS (SELECT DISTINCT child, parent FROM (SELECT node AS child, node // 2 AS parent FROM p UNION ALL SELECT node, node // 3 FROM p) WHERE parent > 0),
      a AS (SELECT child AS node, string_agg(parent || ':' || term, ',' ORDER BY parent) AS parents FROM u JOIN p ON parent = p.node GROUP BY child),
      c AS (SELECT parent AS node, string_agg(child || ':' || term, ',' ORDER BY child) AS children FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS r FROM u) JOIN p ON child = p.node WHERE r <= 50 GROUP BY parent),
      o AS (SELECT x.node, x.tag || ':' || y.node AS relationships FROM p x JOIN p y ON y.node = x.node // 5),
      m AS (SELECT node, string_agg(g || ':' || o || ':' || s || ':' || a, ',' ORDER BY g, o, s, a) AS codes FROM (SELECT DISTINCT l_partkey AS node, l_linenumber AS g, l_orderkey AS o, l_suppkey AS s, l_returnflag AS a FROM lineitem) GROUP BY node)
      SELECT node, coalesce(parents, '') AS parents, coalesce(children, '') AS children, coalesce(relationships, '') AS relationships, md5(coalesce(codes, '')) AS codes FROM p LEFT JOIN a USING (node) LEFT JOIN c USING (node) LEFT JOIN o USING (node) LEFT JOIN m USING (node)""",
    "g11_drug_document": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY type, dst) AS r FROM (SELECT DISTINCT l_suppkey AS src, l_returnflag AS type, l_partkey % 40 + 1 AS dst FROM lineitem)
        WHERE dst IN (SELECT s_suppkey FROM supplier)),
      a AS (SELECT src AS node, string_agg(type || ':' || dst || ':' || s_name || ':' || s_nationkey, ',' ORDER BY type, dst) AS t FROM l JOIN supplier ON s_suppkey = dst WHERE r <= 50 GROUP BY src),
      c AS (SELECT node, string_agg(p_partkey || ':' || p_name || ':' || p_type, ',' ORDER BY p_partkey) AS t FROM (SELECT DISTINCT l_suppkey AS node, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY node)
      SELECT s_suppkey AS node, md5(coalesce(a.t, '')) AS relationships, md5(coalesce(c.t, '')) AS crossrefs FROM supplier LEFT JOIN a ON a.node = s_suppkey LEFT JOIN c ON c.node = s_suppkey""",
}
