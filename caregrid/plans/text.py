"""Text, table and retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.vocabulary import EXPANSIONS
from ..operators import postings as ps
from ..operators import records as rc
from ..operators import retrieval as rt
from ..operators import tables as tb
from ..operators import vectors as vs
from ..operators.store import new_path
from .base import table


def p1(spark, d):
    name = F.format_string("%s (%s)", "p_name", "p_type")
    return table(spark, d, "part").select("p_partkey", sc.trailing_tag(name).alias("tag"), sc.without_tag(name).alias("term"))


def p4(spark, d):
    text = F.regexp_replace("text", r"[^A-Za-z ]", " ")
    return table(spark, d, "documents").select("doc_id", F.md5(sc.expand_words(text, EXPANSIONS)).alias("expanded"))


def p6(spark, d):
    return table(spark, d, "events").select("event_id", sc.confidence_label(F.col("value") / 100).alias("label"))


def p7(spark, d):
    h = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", h.alias("sha256"), F.substring(h, 1, 16).alias("short"))


def p11(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(sc.keywords(F.col("text"), 3), " ").alias("words"))


def p12(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(sc.claims(F.col("text"), 5)).alias("n", "claim"))
    return rows.select("doc_id", "n", F.md5("claim").alias("claim"))


def p15(spark, d):
    """Turns of users that hold a word, newest first, a turn's role being its category and also its reason."""
    cards = table(spark, d, "conversations").select("conv_id", "turn", "text", F.col("role").alias("category"), F.col("role").alias("reason"))
    return rc.card_filter(cards, ["conv_id", "turn"], category="user", search="THE").select("conv_id", "turn")


def p16(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", *[sc.preview(F.col("text"), n).alias(f"p{n}") for n in (60, 80)])


def p18(spark, d):
    return table(spark, d, "events").select("event_id", sc.edge_type(F.concat(F.lit(" "), F.col("event_type"))).alias("type"))


def s14(spark, d):
    raw = F.get_json_object("props", "$.k")
    odd = F.when(F.col("event_id") % 3 == 0, F.concat(raw, F.lit(".7"))).when(F.col("event_id") % 3 == 1, F.lit("Not Available")).otherwise(raw)
    flag = F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("maybe")
    return table(spark, d, "events").select("event_id", sc.safe_int(odd).alias("i"), sc.safe_float(odd).alias("f"), sc.safe_bool(flag).alias("b"), sc.safe_str(F.lit("  ")).alias("s"))


def v9(spark, d):
    return tb.dedup_by_hash(table(spark, d, "documents"), "doc_id", "text")


def j6(spark, d):
    done = table(spark, d, "labels").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("key"))
    return tb.absent(table(spark, d, "documents").select("doc_id"), done, F.concat(F.lit("doc:"), F.col("doc_id")), "key")


def k1(spark, d):
    """Orders, whose totals are overwritten by those of their lines; orders that only have lines are added."""
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    return tb.upsert(old, lines.agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus")), "o_orderkey", ["o_totalprice"])


def k2(spark, d):
    """Labelled documents, and all others as they come."""
    old = table(spark, d, "labels").select("doc_id", F.format_string("quality %d", "quality").alias("lang"))
    return tb.insert_absent(old, table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


def k3(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"), "l_quantity")
    return tb.replace_part(rows, rows.withColumn("l_quantity", F.lit(0.0)), "year", 1995).groupBy("year").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def k4(spark, d):
    return tb.delete_prefix(table(spark, d, "documents"), "source", "src1")[1]


def u1(spark, d):
    o = table(spark, d, "orders")
    pick = lambda p, name: o.filter(F.startswith("o_orderpriority", F.lit(p))).select(F.col("o_custkey").alias("code"), F.lit(name).alias("designation")).distinct()
    return tb.precedence_union(pick("1", "MCC"), pick("2", "CC"), "code")


def u2(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("hospital").alias("type"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("listed").alias("type"))
    return tb.insert_absent(s, c, "id")


def u3(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_name")).alias("aliases"))
    more = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select("s_suppkey", F.array(F.lit("extra"), F.col("s_name")).alias("aliases"))
    return tb.merge_lists(rows, more, "s_suppkey", "aliases").select("s_suppkey", F.array_join("aliases", "|").alias("aliases"))


def u3_unknown(spark, d):
    """Line items' parts that the table of suppliers, taken as ids, has and lacks."""
    return tb.unknown_keys(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), "k")


def _hits(spark, d, k=5):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))
    return rt.top_k(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k)


def v1(spark, d):
    return _hits(spark, d).select("q", "id", F.round("score", 6).alias("score"), "place")


def w1(spark, d):
    return _hits(spark, d).filter("place = 1").select("q", "id")


def v7(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))
    return rt.top_k(q, e.filter("label = 1").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 3).select("q", "id", "place")


def u4(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))
    side = lambda rows, k, tier: rt.top_k(q, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k).select("q", "id", "place", F.lit(tier).alias("tier"))
    lists = side(e.filter("label = 1"), 2, 0).unionByName(side(e.filter("label = 2"), 2, 1)).unionByName(side(e, 4, 2))
    return rt.merge_ranked(lists, 8)


def a25(spark, d):
    """Whether the nearest other vector has the query's label."""
    e = table(spark, d, "embeddings")
    ids = e.groupBy("label").agg(F.collect_list("vec_id").alias("ids"))  # one list a label, for the few labels of the stated queries
    accepted = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "label").join(ids, "label").select("q", "ids")
    others = _hits(spark, d, 2).filter("q <> id")
    first = others.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("place")))
    return rt.hit_at_1(first, accepted)


def v10(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.bm25(q, docs, 3).select("q", "id", "place")


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def v10p(spark, d):
    """The same search over written postings, terms of more than 100 texts being frequent."""
    asked, docs = _asked(spark, d)
    return ps.search(spark, ps.write_postings(docs, new_path(spark, "postings"), hot=100), asked, 3).select("q", "id", "place")


def v1i(spark, d):
    """Each fiftieth vector against an index of all, ten places, 16 lists probed."""
    e = table(spark, d, "embeddings")
    index = vs.write_index(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), new_path(spark, "index"))
    return vs.search(spark, index, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec")), 10, 16)


def v5(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.fixed_chunks(docs).select("id", "chunk", F.md5("text").alias("hash"))


def p5(spark, d):
    """Ratio to the query's best score times 0.95, clamped; and the score itself where it is within 1.5, else its ratio."""
    hits = _hits(spark, d)
    best = F.max("score").over(Window.partitionBy("q"))
    ratio = F.try_divide(F.col("score"), best)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return hits.select("q", "id", F.round(clamp(ratio * 0.95), 6).alias("scaled"), F.round(F.when(best <= 1.5, clamp(F.col("score"))).otherwise(clamp(ratio)), 6).alias("clamped"))


def a26(spark, d):
    """Extensions of page paths, lower case, by number of pages."""
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    return table(spark, d, "pages").groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))


def j7(spark, d):
    """Items without an entry become entries; how many were made and how many were there."""
    return rc.backfill(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")[1]


QUERIES = {
    "p5_score_scaling": p5, "a26_extension_census": a26, "j7_backfill": j7,
    "p1_trailing_tag": p1, "p4_expansion": p4, "p6_labels": p6, "p7_hashes": p7, "p11_keywords": p11, "p12_claims": p12, "p15_filter": p15, "p16_previews": p16, "p18_edge_types": p18,
    "s14_safe_casts": s14, "v9_hash_dedup": v9, "j6_incremental": j6, "k1_upsert": k1, "k2_insert_absent": k2, "k3_replace_vintage": k3, "k4_delete_prefix": k4,
    "u1_precedence_union": u1, "u2_curated_union": u2, "u3_alias_merge": u3, "u3_unknown_ids": u3_unknown, "v1_vector_top_k": v1, "w1_best_candidate": w1, "v7_filtered_retrieval": v7, "u4_ranked_merge": u4,
    "a25_hit_at_1": a25, "v10_bm25": v10, "v10_postings": v10p, "v1_index": v1i, "v5_fixed_chunks": v5,
}

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_TOP = f"SELECT a.vec_id AS q, b.vec_id AS id, {_DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 9) DESC, b.vec_id) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"
_WORDS = "list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: w NOT IN :STOP)"

ORACLE = {
    "p5_score_scaling": f"""WITH h AS (SELECT q, id, round(score, 9) AS score, max(round(score, 9)) OVER (PARTITION BY q) AS best FROM ({_TOP}) WHERE place <= 5)
      SELECT q, id, round(least(greatest(score / best * 0.95, 0), 1), 6) AS scaled, round(CASE WHEN best <= 1.5 THEN least(greatest(score, 0), 1) ELSE least(greatest(score / best, 0), 1) END, 6) AS clamped FROM h""",
    "a26_extension_census": r"SELECT lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1",
    "j7_backfill": "SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS created, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS skipped FROM documents",
    "p1_trailing_tag": "SELECT p_partkey, p_type AS tag, p_name AS term FROM part",
    "p4_expansion": r"""SELECT doc_id, md5(array_to_string(list_transform(regexp_split_to_array(trim(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), '\s+'),
      lambda w: CASE lower(w) :EXPANSIONS ELSE w END), ' ')) AS expanded FROM documents""",
    "p6_labels": "SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'High' WHEN value / 100 >= 0.4 THEN 'Medium' WHEN value / 100 > 0.1 THEN 'Low' ELSE 'Ungrounded' END AS label FROM events",
    "p7_hashes": "SELECT doc_id, sha256(text) AS sha256, left(sha256(text), 16) AS short FROM documents",
    "p11_keywords": f"""SELECT conv_id, turn, array_to_string(list_slice(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), 1, 3), ' ') AS words
      FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations)""",
    "p12_claims": r"""WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)) AS p FROM documents),
      f AS (SELECT doc_id, list_slice(list_filter(p, lambda x: length(x) > 20 AND NOT (starts_with(lower(x), 'i ') OR starts_with(lower(x), 'i''m ') OR starts_with(lower(x), 'let me') OR starts_with(lower(x), 'please')
        OR starts_with(lower(x), 'thank') OR starts_with(lower(x), 'sure') OR starts_with(lower(x), 'of course'))), 1, 5) AS p FROM s)
      SELECT doc_id, unnest(range(len(p)))::INT AS n, md5(unnest(p)) AS claim FROM f""",
    "p15_filter": "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')",
    "p16_previews": "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS p60, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS p80 FROM conversations",
    "p18_edge_types": "SELECT event_id, CASE WHEN regexp_matches(upper(trim(event_type)), '^[A-Z][A-Z0-9_]{0,49}$') THEN upper(trim(event_type)) END AS type FROM events",
    "s14_safe_casts": """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k') || '.7' WHEN 1 THEN 'Not Available' ELSE json_extract_string(props, '$.k') END AS odd FROM events)
      SELECT event_id, trunc(try_cast(odd AS DOUBLE))::INT AS i, try_cast(odd AS DOUBLE) AS f, CASE WHEN event_id % 2 = 0 THEN true END AS b, NULL::VARCHAR AS s FROM r""",
    "v9_hash_dedup": "SELECT doc_id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY text) AS kept_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents",
    "j6_incremental": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "k1_upsert": """WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1)
      SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, coalesce(p, o_totalprice) AS o_totalprice, coalesce(o_orderstatus, 'X') AS o_orderstatus FROM orders FULL JOIN l ON l_orderkey = o_orderkey""",
    "k2_insert_absent": "SELECT doc_id, 'quality ' || quality AS lang FROM labels UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "k3_replace_vintage": "SELECT year(l_shipdate)::INT AS year, count(*) AS n, sum(CASE WHEN year(l_shipdate) = 1995 THEN 0 ELSE l_quantity END) AS q FROM lineitem GROUP BY 1",
    "k4_delete_prefix": "SELECT count(*) AS deleted FROM documents WHERE starts_with(source, 'src1')",
    "u1_precedence_union": """SELECT o_custkey AS code, CASE WHEN min(left(o_orderpriority, 1)) = '1' THEN 'MCC' ELSE 'CC' END AS designation FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2') GROUP BY 1""",
    "u2_curated_union": "SELECT s_suppkey AS id, s_name AS name, 'hospital' AS type FROM supplier UNION ALL SELECT c_custkey, c_name, 'listed' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "u3_unknown_ids": "SELECT count(*) FILTER (k IN (SELECT s_suppkey FROM supplier)) AS known, count(*) FILTER (k NOT IN (SELECT s_suppkey FROM supplier)) AS unknown FROM (SELECT DISTINCT l_partkey AS k FROM lineitem)",
    "u3_alias_merge": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '|extra' ELSE s_name END AS aliases FROM supplier",
    "v1_vector_top_k": f"SELECT q, id, round(score, 6) AS score, place FROM ({_TOP}) WHERE place <= 5",
    "w1_best_candidate": f"SELECT q, id FROM ({_TOP}) WHERE place = 1",
    "v7_filtered_retrieval": f"SELECT q, id, place FROM ({_TOP} AND b.label = 1) WHERE place <= 3",
    "u4_ranked_merge": f"""WITH l AS (SELECT q, id, place, 0 AS tier FROM ({_TOP} AND b.label = 1) WHERE place <= 2 UNION ALL SELECT q, id, place, 1 FROM ({_TOP} AND b.label = 2) WHERE place <= 2
        UNION ALL SELECT q, id, place, 2 FROM ({_TOP}) WHERE place <= 4),
      o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY tier, place) = 1)
      SELECT q, id, tier, row_number() OVER (PARTITION BY q ORDER BY tier, place, id) AS rank FROM o QUALIFY rank <= 8""",
    "a25_hit_at_1": f"""WITH h AS (SELECT q, id FROM ({_TOP}) WHERE place <= 2 AND q <> id QUALIFY row_number() OVER (PARTITION BY q ORDER BY place) = 1)
      SELECT count(*) FILTER (a.label = b.label) AS passed, count(*) FILTER (a.label <> b.label) AS failed FROM h JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = id""",
    "v10_bm25": """WITH s AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM s),
      t AS (SELECT DISTINCT item_id AS q, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark),
      tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM s) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      sc AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN t USING (term), st GROUP BY q, id)
      SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM sc QUALIFY place <= 3""",
    "v5_fixed_chunks": """SELECT id, chunk, md5(substring(text, (chunk * 1500 + 1)::BIGINT, 2000)) AS hash
      FROM (SELECT doc_id AS id, text, unnest(range(greatest(ceil((length(text) - 500) / 1500.0), 1)::BIGINT))::INT AS chunk FROM documents)""",
}
ORACLE["v10_postings"] = ORACLE["v10_bm25"]
