"""Queries over evidence: grounding, reranking, reports, scoped graphs and the impact of coding gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import casemix as cm
from ..operators import graph as gr
from ..operators import retrieval as rt
from . import casemix, text
from .base import table


def a24(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    hits = text._hits(spark, d).join(labels, "id").select("q", "score", F.col("label").alias("source"), (F.col("label") == 1).alias("curated"))
    asked = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), (F.col("vec_id") % 6 / 5).alias("coverage"), (F.col("vec_id") % 100 == 0).alias("reasoned"))
    return rt.grounding(hits, asked)


def v3(spark, d):
    """Fifteen candidates by BM25, of which the five with most of the query's words stay."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.rerank(rt.bm25(asked, docs, 15), asked, docs, 5).select("q", "id", "place")


def v8(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    hits = text._hits(spark, d).join(labels, "id")
    return hits.select("q", "place", F.to_json(F.struct(F.col("place").alias("rank"), F.col("id").alias("source"), F.col("label").alias("tag"))).alias("report"))


def v8_full(spark, d):
    """Hits with the document of the vector's id as their chunk."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("tag"), "text")
    return rt.chunk_report(text._hits(spark, d), chunks).select("q", "rank", F.round("score", 6).alias("score"), "source", "tag", F.md5("excerpt").alias("excerpt"))


def p5_mean(spark, d):
    """Mean scores ten times as large as they are, so that they are divided by the best."""
    hits = text._hits(spark, d).withColumn("score", F.col("score") * 10)
    return rt.mean_scores(table(spark, d, "embeddings").select(F.col("vec_id").alias("q")), hits)


def v4_new(spark, d):
    """Documents without a label that are not in English are encoded; how many words count in their vectors' length."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("tag"))
    vectors = rt.embed_new(docs, table(spark, d, "labels").select(F.col("doc_id").alias("id")), ["en"])
    return vectors.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def _talk(spark, d):
    """Conversations and the concepts that their turns mention."""
    c = table(spark, d, "conversations")
    return c.select(F.concat(F.lit("c"), "conv_id").alias("src"), F.explode(sc.keywords(F.col("text"), 5)).alias("dst"), F.col("role").alias("type"))


def _anchors(spark, d):
    return table(spark, d, "conversations").filter("conv_id % 50 = 0").select(F.concat(F.lit("c"), "conv_id").alias("node")).distinct()


def g6(spark, d):
    """Two steps around each anchor over edges of one type; the nearest 50 nodes an anchor."""
    return gr.scoped(_talk(spark, d), _anchors(spark, d), 2, ["user"])[0]


def g7(spark, d):
    """The nearest fifty artifacts (conversations) within three steps of each anchor."""
    talk = _talk(spark, d)
    return gr.artifact_lineage(talk, _anchors(spark, d), talk.select(F.col("src").alias("node"), F.lit("session").alias("label")), ["session"]).select("seed", "node", "distance", "place")


def g8(spark, d):
    """The first twenty suppliers whose name or nation holds the text, with the parts whose lines name them: edges that end in a hit."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = s.select(F.format_string("s%06d", "s_suppkey").alias("node"), "s_name", "n_name")
    lines = table(spark, d, "lineitem").select(F.format_string("p%06d", "l_partkey").alias("src"), F.format_string("s%06d", "l_suppkey").alias("dst"))
    return gr.node_search(nodes, lines, "5", ["s_name", "n_name"])


def a24_tools(spark, d):
    """Events as calls of tools, a user a question: bytes of their results, three rounds at most."""
    last = F.when(F.col("value") > 95, 3).otherwise(F.col("event_id") % 2 + 1)
    return rt.tool_grounding(table(spark, d, "events").select(F.col("user_id").alias("q"), F.floor("value").cast("long").alias("bytes"), last.alias("round")), 3)


def n9(spark, d):
    """Impact of each gap: by DRG weights where its condition has them, else by designations of its codes."""
    titles = casemix._titles(spark, d).select("title", "weight")
    parts = sc.severity(F.col("title"))
    weights = titles.select(parts["base"].alias("base"), parts["status"].alias("status"), "weight")
    named = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.when(F.col("s_acctbal") > 5000, "MCC").when(F.col("s_acctbal") > 0, "CC").alias("designation"))
    base = F.when(F.col("p_size") % 5 == 0, "UNMAPPED").otherwise(F.col("p_type"))
    codes = F.array((F.col("p_partkey") % 100 + 1).cast("string"), F.col("p_size").cast("string"))
    gaps = table(spark, d, "part").select(F.col("p_partkey").alias("gap_id"), base.alias("base"), (F.col("p_partkey") % 10 + 1).cast("string").alias("current"), codes.alias("codes"))
    return cm.gap_impact(gaps, named, weights)


QUERIES = {"a24_grounding": a24, "a24_tool_results": a24_tools, "v3_rerank": v3, "v8_chunk_report": v8, "v8_full_report": v8_full, "p5_mean_score": p5_mean, "v4_new_vectors": v4_new, "g6_scoped_subgraph": g6, "g7_lineage": g7, "g8_node_search": g8, "n9_gap_impact": n9}

_HITS = f"(SELECT t.*, e.label FROM ({text._TOP}) t JOIN embeddings e ON e.vec_id = t.id WHERE place <= 5)"
_CANDIDATES = text.ORACLE["v10_bm25"].replace("place <= 3", "place <= 15")
_BAG = "list_distinct(regexp_extract_all(lower(%s), '[a-z0-9]{2,}'))"
_TALK = """e AS (SELECT DISTINCT 'c' || conv_id AS src, concept AS dst, role AS type FROM (SELECT conv_id, role, unnest(list_slice(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), 1, 5)) AS concept
  FROM (SELECT conv_id, role, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN :STOP) AS w FROM conversations)))"""
_NEAR = """b AS (SELECT src, dst FROM e {where} UNION SELECT dst, src FROM e {where}), h AS (SELECT DISTINCT 'c' || conv_id AS seed, 'c' || conv_id AS node, 0 AS distance FROM conversations WHERE conv_id % 50 = 0
  UNION SELECT seed, dst, distance + 1 FROM h JOIN b ON node = src WHERE distance < {depth}), n AS (SELECT seed, node, min(distance) AS distance FROM h GROUP BY seed, node HAVING min(distance) > 0)"""

ORACLE = {
    "a24_grounding": f"""WITH h AS (SELECT q, round(score, 9) AS s, label FROM {_HITS}), m AS (SELECT *, max(s) OVER (PARTITION BY q) AS top FROM h),
      g AS (SELECT q, avg(CASE WHEN top > 1.5 THEN s / top ELSE greatest(least(s, 1), 0) END) AS r, count(*) FILTER (label = 1) AS c, least(count(DISTINCT label) / 3, 1) AS v FROM m GROUP BY q),
      f AS (SELECT q, CASE WHEN c >= 2 THEN greatest(r, 0.9) WHEN c = 1 THEN greatest(r, 0.75) ELSE r END AS r, v, CASE WHEN c >= 2 THEN greatest((q % 6) / 5, 0.85) WHEN c = 1 THEN greatest((q % 6) / 5, 0.7) ELSE (q % 6) / 5 END AS k,
        CASE WHEN q % 100 = 0 THEN 1.0 ELSE 0.0 END AS t FROM g),
      o AS (SELECT q, round(0.4::DOUBLE * r + 0.3::DOUBLE * k + 0.2::DOUBLE * v + 0.1::DOUBLE * t, 3) AS overall, round(r, 3) AS retrieval, round(k, 3) AS coverage, round(v, 3) AS diversity FROM f)
      SELECT *, CASE WHEN overall >= 0.7 THEN 'High' WHEN overall >= 0.4 THEN 'Medium' WHEN overall > 0.1 THEN 'Low' ELSE 'Ungrounded' END AS label FROM o""",
    "v3_rerank": f"""WITH c AS (SELECT q, id FROM ({_CANDIDATES})), s AS (SELECT q, id, round(len(list_intersect({_BAG % "b.text"}, {_BAG % "d.text"})) / len({_BAG % "b.text"}), 9) AS s FROM c JOIN benchmark b ON item_id = q JOIN documents d ON doc_id = id)
      SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS place FROM s QUALIFY place <= 5""",
    "v8_chunk_report": f"""SELECT q, place, '{{"rank":' || place || ',"source":' || id || ',"tag":' || label || '}}' AS report FROM {_HITS}""",
    "g6_scoped_subgraph": f"WITH RECURSIVE {_TALK}, {_NEAR.format(where="WHERE type = 'user'", depth=2)} SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS place FROM n QUALIFY place <= 50",
    "g7_lineage": f"WITH RECURSIVE {_TALK}, {_NEAR.format(where='', depth=3)} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS place FROM n WHERE regexp_matches(node, '^c[0-9]+$')) WHERE place <= 50",
    "g8_node_search": """WITH f AS (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '5') OR contains(lower(n_name), '5') ORDER BY s_suppkey LIMIT 20)
      SELECT DISTINCT printf('s%06d', s_suppkey) AS node, printf('p%06d', l_partkey) AS neighbor FROM f LEFT JOIN lineitem ON l_suppkey = s_suppkey""",
    "a24_tool_results": """WITH t AS (SELECT user_id AS q, count(*) AS calls, sum(floor(value)::BIGINT)::BIGINT AS bytes, max(CASE WHEN value > 95 THEN 3 ELSE event_id % 2 + 1 END) >= 3 AS spent FROM events GROUP BY 1)
      SELECT q, calls, bytes, CASE WHEN bytes > 500 AND NOT spent THEN 0.95 WHEN bytes > 100 THEN 0.7 ELSE 0.35 END::DOUBLE AS overall, CASE WHEN bytes > 500 AND NOT spent THEN 'High' WHEN bytes > 100 THEN 'Medium' ELSE 'Low' END AS label FROM t""",
    "n9_gap_impact": """WITH n AS (SELECT s_suppkey::VARCHAR AS code, CASE WHEN s_acctbal > 5000 THEN 'MCC' WHEN s_acctbal > 0 THEN 'CC' END AS designation FROM supplier),
      w AS (SELECT p_type, min(w) FILTER (k = 2) AS n, min(w) FILTER (k = 1) AS c, min(w) FILTER (k = 0) AS m FROM (SELECT p_type, p_size % 4 AS k, round(p_retailprice / 1000, 4) AS w FROM part) GROUP BY p_type),
      g AS (SELECT p_partkey AS gap_id, CASE WHEN p_size % 5 = 0 THEN 'UNMAPPED' ELSE p_type END AS base, (p_partkey % 100 + 1)::VARCHAR AS c1, p_size::VARCHAR AS c2, (p_partkey % 10 + 1)::VARCHAR AS current FROM part),
      j AS (SELECT g.*, n1.designation AS d1, n2.designation AS d2, coalesce(n0.designation, 'NONE') AS d0, coalesce(w.n, w.c) AS low, CASE WHEN w.n IS NOT NULL THEN 'NONE' WHEN w.c IS NOT NULL THEN 'CC' END AS have, coalesce(w.m, w.c) AS high,
          CASE WHEN w.m IS NOT NULL THEN 'MCC' WHEN w.c IS NOT NULL THEN 'CC' END AS want
        FROM g LEFT JOIN n n1 ON n1.code = c1 LEFT JOIN n n2 ON n2.code = c2 LEFT JOIN n n0 ON n0.code = current LEFT JOIN w ON w.p_type = base),
      k AS (SELECT *, coalesce(have <> want, false) AS mapped, CASE WHEN 'MCC' IN (coalesce(d1, ''), coalesce(d2, '')) THEN 'MCC' WHEN 'CC' IN (coalesce(d1, ''), coalesce(d2, '')) THEN 'CC' END AS best FROM j),
      x AS (SELECT *, CASE WHEN d0 = 'NONE' AND best = 'CC' THEN 0.5038 WHEN d0 = 'NONE' AND best = 'MCC' THEN 1.8111 WHEN d0 = 'CC' AND best = 'MCC' THEN 1.3188 END AS shift, CASE WHEN mapped THEN want ELSE best END AS goal FROM k)
      SELECT gap_id, CASE WHEN mapped THEN 'principal' WHEN shift IS NOT NULL THEN 'comorbidity' ELSE 'none' END AS kind,
        CASE WHEN mapped OR shift IS NOT NULL THEN CASE WHEN d1 = goal THEN c1 WHEN d2 = goal THEN c2 ELSE c1 END END AS target_code, round(CASE WHEN mapped THEN high - low ELSE shift END, 4)::DOUBLE AS weight_delta,
        round(round(CASE WHEN mapped THEN high - low ELSE shift END, 4)::DOUBLE * 7200, 2) AS revenue FROM x""",
    "v8_full_report": f"SELECT q, place AS rank, round(score, 6) AS score, source, lang AS tag, md5(substr(text, 1, 300)) AS excerpt FROM ({text._TOP}) LEFT JOIN documents ON doc_id = id WHERE place <= 5",
    "p5_mean_score": f"""WITH h AS (SELECT q, score * 10 AS s, max(score * 10) OVER (PARTITION BY q) AS best FROM ({text._TOP}) WHERE place <= 5)
      SELECT vec_id AS q, coalesce(m, 0) AS retrieval FROM embeddings LEFT JOIN (SELECT q, round(avg(CASE WHEN best <= 1.5 THEN least(greatest(s, 0), 1) ELSE s / best END), 6) AS m FROM h GROUP BY q) ON q = vec_id""",
    "v4_new_vectors": """SELECT doc_id AS id, CASE WHEN regexp_matches(lower(text), '[a-z0-9]{2,}') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'en'""",
}
