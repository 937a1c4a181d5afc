"""Queries that check notes: an order is a note, its parts are the concepts found in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import graph as gr
from ..operators import notes as nt
from ..operators import retrieval as rt
from ..operators.ingest import IngestJob
from ..operators.store import new_path, written
from . import text
from .base import table

KINDS = list(nt.EXPECTED)
#: Categories by part size, tags expected of a category, types of drug entries, the cue of a denial.
CATEGORIES = ["condition", "procedure", "symptom", "medication"]
TAGS = {"condition": ["economy", "standard", "disorder"], "procedure": ["promo", "procedure"], "symptom": ["economy", "promo", "standard"]}
DRUG_TYPES = ["in", "bn"]
CUE = "small "
#: What a rule asks for as (name, required, patterns, values, codes).
ATTRIBUTES = [("kind", True, ["(cold|old) widget", "rod"], ["O"], []), ("state", True, ["new [a-z]+"], [], ["3", "5", "8"]), ("color", False, ["blue"], [], [])]


def _parts(spark, d):
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("term"), F.col("p_type").alias("mapped_term"), F.col("p_type").alias("tag"), category.alias("category"))


def _concepts(spark, d):
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note"), "l_partkey").agg(
        (F.min("l_returnflag") == "R").alias("negated"), F.max("l_linestatus").alias("qualifier"), F.round(1 - F.max("l_discount") - F.max("l_tax"), 4).alias("confidence")
    )
    rows = found.join(_parts(spark, d), "l_partkey")
    return rows.withColumn("line", F.col("l_partkey")).withColumn("code", F.col("l_partkey").cast("string")).drop("l_partkey")


def _tree(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("c"))
    up = p.select("c", F.explode(F.array_distinct(F.array(F.expr("c div 2"), F.expr("c div 3")))).alias("p")).filter("p > 0")
    return up.select(F.col("c").cast("string").alias("child"), F.col("p").cast("string").alias("parent"))


def _expectations(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type")
    steps = F.explode(F.array(*map(F.lit, (2, 3, 5, 7, 11, 13)))).alias("s")
    kind = F.coalesce(F.get(F.array(*map(F.lit, KINDS)), ((F.col("k") + F.col("s")) % 12).cast("int")), F.lit("IS_A"))
    edges = p.select("k", steps).filter("k >= s").select(F.col("k").cast("string").alias("src"), F.expr("k div s").cast("string").alias("dst"), kind.alias("type"))
    term = F.format_string("%s (%s)", "p_name", "p_type")
    synonyms = F.when(F.col("k") % 2 == 0, F.array("p_type"))
    return nt.expected_concepts(edges, p.select(F.col("k").cast("string").alias("code"), term.alias("term"), synonyms.alias("synonyms")))


def _rules(spark, d):
    """A rule a nation, with the condition of the part of the same number."""
    attributes = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(r).alias("required"), *[F.array(*map(F.lit, v)).cast("array<string>").alias(c) for c, v in (("patterns", p), ("values", v), ("codes", k))])
        for n, r, p, v, k in ATTRIBUTES
    ])
    p = table(spark, d, "nation").join(table(spark, d, "part"), F.col("n_nationkey") == F.col("p_partkey"))
    return p.select(F.concat(F.lit("r"), "n_nationkey").alias("rule_id"), F.concat_ws(" ", "p_name", "p_type").alias("condition"), F.array((F.col("p_partkey") * 7).cast("string")).alias("codes"), attributes.alias("attributes"))


def _note_texts(concepts):
    return concepts.groupBy("note").agg(F.array_join(F.array_sort(F.collect_set("term")), ". ").alias("text"))


def j11(spark, d):
    return nt.matching_rules(_concepts(spark, d), _rules(spark, d), _tree(spark, d)).select("code", "rule_id", "tier")


def j12(spark, d):
    return _expectations(spark, d).select("code", "kind", "priority", "target", "target_term", F.array_join("synonyms", "|").alias("synonyms"))


def n1(spark, d):
    e = table(spark, d, "embeddings")
    category = F.element_at(F.array(*map(F.lit, ["condition", "medication", "procedure"])), F.col("label") % 3 + 1)
    concepts = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), category.alias("category"))
    drug = F.col("vec_id") % 2 == 1
    tag = F.when(drug, F.when(F.col("vec_id") % 3 == 0, "IN").otherwise("zz")).otherwise(F.when(F.col("vec_id") % 4 == 0, "Disorder").otherwise("procedure"))
    entries = e.select(F.col("vec_id").alias("id"), F.when(drug, "rxnorm").otherwise("snomed").alias("ontology"), tag.alias("tag"))
    return nt.map_concepts(concepts, text._hits(spark, d), entries, TAGS, "medication", DRUG_TYPES)


def p17(spark, d):
    codes = table(spark, d, "lineitem").filter("l_discount > 0.04").groupBy(F.col("l_orderkey").alias("note"), F.col("l_partkey").alias("line")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("codes"))
    return nt.code_suggestions(_concepts(spark, d).join(codes, ["note", "line"], "left"), 0.88).withColumn("codes", F.array_join("codes", ","))


def p19(spark, d):
    k = F.col("p_partkey")
    nodes = table(spark, d, "part").select(k.alias("id"), F.when(k % 2 == 0, F.col("p_name")).alias("name"), F.when(k % 3 == 0, F.col("p_type")).alias("text"), F.when(k % 5 == 0, k + 1000000).alias("card_id"))
    return gr.node_names(nodes)


def _coverage(spark, d, concepts=None):
    return nt.coverage(concepts or _concepts(spark, d), _expectations(spark, d), ["condition", "procedure"])


def n2(spark, d):
    return _coverage(spark, d)[0]


def n2_missing(spark, d):
    return _coverage(spark, d)[1]


def _consistency(spark, d, concepts=None):
    return nt.consistency(concepts or _concepts(spark, d), _tree(spark, d), TAGS)


def n3(spark, d):
    return _consistency(spark, d)[0]


def _specificity(spark, d, concepts=None):
    concepts = concepts or written(_concepts(spark, d), "concepts")
    return nt.specificity(concepts, _note_texts(concepts), _rules(spark, d), _tree(spark, d), ["condition", "symptom"], CUE)


def n4(spark, d):
    return _specificity(spark, d)[0]


def n4_gaps(spark, d):
    return _specificity(spark, d)[1]


def n5(spark, d):
    """Each check is written on its own, a row a note, so that only one check's shuffles are there at a time."""
    concepts = written(_concepts(spark, d), "concepts")
    mapped = concepts.groupBy("note").agg(F.count_if(F.col("confidence") >= 0.9).alias("mapped"), F.count("*").alias("concepts"))
    covered = written(_coverage(spark, d, concepts)[0], "covered")
    verdicts = written(_consistency(spark, d, concepts)[1], "verdicts")
    return nt.note_report(written(mapped, "mapped"), covered, verdicts, written(_specificity(spark, d, concepts)[0], "specific"))


def _claims(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(sc.claims(F.col("text"), 5)).alias("n", "claim"))
    return rows.select((F.col("item_id") * 10 + F.col("n")).alias("q"), "claim")


def _vectors(spark, d):
    return rt.embed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def n6(spark, d):
    claims = _claims(spark, d)
    asked = rt.embed(claims.select(F.col("q").alias("id"), F.col("claim").alias("text"))).select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    mentions = claims.select("q", F.explode(sc.keywords(F.col("claim"), 3)).alias("concept"))
    nodes = table(spark, d, "conversations").select(F.explode(sc.keywords(F.col("text"), 5)).alias("name"))
    return nt.validated_claims(claims, rt.top_k(asked, _vectors(spark, d), 3), mentions, nodes)


def v2(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    queries = rt.embed(b).join(b, "id").select(F.col("id").alias("q"), "text", F.col("vec").alias("qvec"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source").join(_vectors(spark, d), "id")
    return rt.retrieve(queries, docs, [F.col("source") == "src0", F.col("source") == "src1"])


def v4(spark, d):
    rows = _vectors(spark, d).select("id", F.posexplode("vec").alias("b", "v")).filter("v > 0")
    return rows.select("id", "b", F.round("v", 9).alias("v"))


def v5r(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.recursive_chunks(docs).select("id", "chunk", F.length("text").alias("n"), F.md5("text").alias("hash"))


def v6(spark, d):
    """The states of the ingest job after it has run over all documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return IngestJob(spark, new_path(spark, "ingest")).run(docs)


QUERIES = {
    "j11_rule_cascade": j11, "j12_expected_concepts": j12, "n1_concept_mapping": n1, "n2_coverage": n2, "n2_missing": n2_missing, "n3_consistency": n3, "n4_specificity": n4,
    "n4_gaps": n4_gaps, "n5_note_report": n5, "n6_claim_validation": n6, "v2_full_retrieval": v2, "v4_embedding": v4, "v5_recursive_chunks": v5r, "v6_ingest_status": v6,
    "p17_code_suggestions": p17, "p19_node_names": p19,
}

_CONCEPTS = """c AS (SELECT l_orderkey AS note, l_partkey AS line, l_partkey::VARCHAR AS code, min(l_returnflag) = 'R' AS negated, max(l_linestatus) AS qualifier, round(1 - max(l_discount) - max(l_tax), 4) AS confidence,
    any_value(p_name) AS term, any_value(p_type) AS mapped_term, ['condition', 'procedure', 'symptom', 'medication'][any_value(p_size) % 4 + 1] AS category FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""
_TREE = "t AS (SELECT DISTINCT p_partkey AS c, unnest([p_partkey // 2, p_partkey // 3]) AS p FROM part)"
_KINDS = "['FINDING_SITE', 'ASSOCIATED_MORPHOLOGY', 'DIRECT_MORPHOLOGY', 'CAUSATIVE_AGENT', 'PATHOLOGICAL_PROCESS', 'DUE_TO', 'PROCEDURE_SITE_DIRECT', 'METHOD', 'INTERPRETS', 'AFTER']"
_EXPECTED = f"""x0 AS (SELECT p_partkey AS k, unnest([2, 3, 5, 7, 11, 13]) AS s FROM part), x1 AS (SELECT k, k // s AS dst, (k + s) % 12 AS i FROM x0 WHERE k >= s),
  x AS (SELECT k::VARCHAR AS code, {_KINDS}[i + 1] AS kind, CASE WHEN i < 3 THEN 'high' WHEN i < 7 THEN 'medium' ELSE 'low' END AS priority, i < 7 AS scored, dst::VARCHAR AS target,
      p_name || ' (' || p_type || ')' AS target_term, p_name AS core, CASE WHEN dst % 2 = 0 THEN p_type END AS synonym FROM x1 JOIN part ON p_partkey = dst WHERE i < 10)"""
_COVERAGE = f"""{_CONCEPTS}, {_EXPECTED},
  y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, scored ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, kind, target) AS n FROM x) WHERE NOT scored OR n <= 5),
  k AS (SELECT note, line, code, lower(term) AS term FROM c WHERE confidence >= 0.3 AND NOT negated AND category IN ('condition', 'procedure')),
  doc AS (SELECT note, list(DISTINCT code) AS codes, list(DISTINCT lower(term)) || list(DISTINCT lower(mapped_term)) AS terms FROM c WHERE confidence >= 0.3 GROUP BY note),
  ck AS (SELECT note, list(DISTINCT term) AS checked FROM k GROUP BY note),
  r AS (SELECT k.note, k.line, y.*, codes, terms, array_to_string(terms || CASE WHEN scored THEN [k.term] ELSE checked END, ' ||| ') AS blob, list_filter([lower(core), lower(synonym)], lambda v: v IS NOT NULL) AS names
    FROM k LEFT JOIN y USING (code) JOIN doc ON doc.note = k.note JOIN ck ON ck.note = k.note),
  m AS (SELECT *, coalesce(list_contains(codes, target) OR list_contains(terms, lower(target_term)) OR len(list_filter(names, lambda v: length(v) >= 3 AND contains(blob, v))) > 0
      OR len(list_filter(string_split(array_to_string(names, ' '), ' '), lambda v: length(v) >= 6 AND contains(blob, left(v, 6)))) > 0, false) AS met FROM r),
  sh AS (SELECT note, line, coalesce(count(*) FILTER (scored AND met) / nullif(count(*) FILTER (scored), 0), 1) AS s FROM m GROUP BY note, line),
  n2 AS (SELECT note, coalesce(any_value(v), 1)::DOUBLE AS coverage, coalesce(any_value(n), 0) AS checked FROM (SELECT DISTINCT note FROM c) LEFT JOIN (SELECT note, round(round(avg(s), 9)::DECIMAL(18, 9), 3) AS v, count(*) AS n FROM sh GROUP BY note) USING (note) GROUP BY note)"""
_RULES = """ru AS (SELECT 'r' || n_nationkey AS rule_id, lower(p_name || ' ' || p_type) AS cond, (p_partkey * 7)::VARCHAR AS rc FROM nation JOIN part ON p_partkey = n_nationkey)"""
_MATCH = f"""{_TREE}, {_RULES}, k1 AS (SELECT DISTINCT code, lower(term) AS term FROM {{concepts}}),
  an AS (SELECT DISTINCT c, p FROM t WHERE p > 0 UNION SELECT a.c, b.p FROM t a JOIN t b ON a.p = b.c WHERE a.p > 0 AND b.p > 0),
  w AS (SELECT *, list_distinct(list_filter(string_split(cond, ' '), lambda v: length(v) >= 4 AND v NOT IN ('with', 'acute', 'chronic', 'type', 'unspecified'))) AS words FROM ru),
  f AS (SELECT code, term, rule_id, 1 AS tier FROM k1 JOIN ru ON rc = code UNION SELECT code, term, rule_id, 2 FROM k1 JOIN an ON c::VARCHAR = code JOIN ru ON rc = p::VARCHAR
    UNION SELECT code, term, rule_id, 3 FROM k1 JOIN w ON contains(term, cond) OR contains(cond, term) OR len(words) > 0 AND len(list_intersect(words, string_split(term, ' '))) >= len(words) // 2 + 1),
  mr AS (SELECT * FROM f QUALIFY tier = min(tier) OVER (PARTITION BY code, term))"""
_TEXTS = "tx AS (SELECT note, lower(string_agg(DISTINCT term, '. ' ORDER BY term)) AS t FROM c GROUP BY note)"
_SPECIFIC = f"""{_TEXTS},
  pk AS (SELECT c.note, line, code, lower(term) AS term, lower(qualifier) AS q, t FROM c JOIN tx USING (note) WHERE confidence >= 0.5 AND NOT negated AND category IN ('condition', 'symptom')
    AND len(list_filter(string_split(t, lower(term))[:-2], lambda v: contains(right(v, 80), 'small '))) = 0), {_MATCH.format(concepts='pk')},
  o AS (SELECT note, rule_id, min(line) AS line, arg_min(term, line) AS term, arg_min(q, line) AS q, arg_min(t, line) AS t FROM pk JOIN mr USING (code, term) GROUP BY note, rule_id),
  sd AS (SELECT note, list(DISTINCT code) AS said FROM c WHERE NOT negated GROUP BY note),
  v AS (SELECT o.*, coalesce(nullif(regexp_extract(t, '(cold|old) widget', 1), ''), nullif(regexp_extract(t, 'rod'), ''), CASE WHEN q = 'o' THEN q END) AS kind,
      coalesce(nullif(regexp_extract(t, 'new [a-z]+'), ''), CASE WHEN list_contains(said, '3') THEN '3' WHEN list_contains(said, '5') THEN '5' WHEN list_contains(said, '8') THEN '8' END) AS state, nullif(regexp_extract(t, 'blue'), '') AS color FROM o LEFT JOIN sd USING (note)),
  g AS (SELECT note, rule_id, line, term, array_to_string(list_filter([CASE WHEN kind IS NULL THEN 'kind' END, CASE WHEN state IS NULL THEN 'state' END], lambda v: v IS NOT NULL), ',') AS missing,
      array_to_string(list_filter(['kind: ' || kind, 'state: ' || state, 'color: ' || color], lambda v: v IS NOT NULL), '; ') AS present FROM v),
  n4 AS (SELECT note, coalesce(any_value(s), 1)::DOUBLE AS specificity, coalesce(any_value(n), 0) AS rules FROM tx LEFT JOIN (SELECT note, round(round(avg(CASE missing WHEN '' THEN 1 ELSE 0 END), 9)::DECIMAL(18, 9), 3) AS s, count(*) AS n FROM g GROUP BY note) USING (note) GROUP BY note)"""
_NEGATED = "SELECT note, lower(trim(term)) AS what FROM c GROUP BY 1, 2 HAVING bool_or(negated) AND bool_or(NOT negated)"
_VECTORS = """{n}w AS (SELECT {id} AS id, ('0x' || left(md5(w), 4))::INT % 64 AS b, count(*) AS n FROM (SELECT {id}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}')) AS w FROM {table}) GROUP BY 1, 2),
  {n} AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS v FROM {n}w)"""
_DOC_VECTORS = _VECTORS.format(n="dv", id="doc_id", text="text", table="documents")
_CLAIMS = """cl AS (SELECT item_id * 10 + unnest(range(len(p))) AS q, unnest(p) AS claim FROM (SELECT item_id, list_slice(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)),
  lambda x: length(x) > 20 AND NOT regexp_matches(lower(x), '^(i |i''m |let me|please|thank|sure|of course)')), 1, 5) AS p FROM benchmark))"""
_KEYS = "list_slice(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), 1, {n})"
_SEARCH = "SELECT {q}.id AS q, d.id, round(sum({q}.v * d.v), 9) AS score FROM {q} JOIN (SELECT dv.* FROM dv JOIN documents ON doc_id = id WHERE {only}) d ON d.b = {q}.b GROUP BY 1, 2"
_SCORED = "(SELECT q, d.id, coalesce(score, 0) AS score FROM (SELECT DISTINCT id AS q FROM {q}) CROSS JOIN (SELECT doc_id AS id FROM documents WHERE {only}) d LEFT JOIN ({search}) USING (q, id))"


def _found(q: str, only: str) -> str:
    return _SCORED.format(q=q, only=only, search=_SEARCH.format(q=q, only=only))


_BAG = "list_distinct(regexp_extract_all(lower(%s), '[a-z0-9]{2,}'))"

ORACLE = {
    "p17_code_suggestions": f"""WITH {_CONCEPTS}, k AS (SELECT l_orderkey AS note, l_partkey AS line, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS codes FROM lineitem WHERE l_discount > 0.04 GROUP BY 1, 2)
      SELECT note, line, term, codes FROM c JOIN k USING (note, line) WHERE confidence >= 0.88""",
    "p19_node_names": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 5 = 0 THEN (p_partkey + 1000000)::VARCHAR ELSE p_partkey::VARCHAR END AS label FROM part",
    "j11_rule_cascade": f"WITH {_CONCEPTS}, {_MATCH.format(concepts='c')} SELECT code, rule_id, tier FROM mr",
    "j12_expected_concepts": f"WITH {_EXPECTED} SELECT code, kind, priority, target, target_term, synonym AS synonyms FROM x",
    "n1_concept_mapping": f"""WITH h AS (SELECT q, id, place, round(score, 9) AS score FROM ({text._TOP}) WHERE place <= 5),
      r AS (SELECT *, CASE WHEN score > 0 THEN round(least(score / max(score) OVER (PARTITION BY q) * 0.95, 1), 3) ELSE 0 END AS k, id % 2 = 1 AS drug, CASE WHEN id % 2 = 1 THEN CASE id % 3 WHEN 0 THEN 'in' ELSE 'zz' END WHEN id % 4 = 0 THEN 'disorder' ELSE 'procedure' END AS tag FROM h),
      j AS (SELECT r.*, ['condition', 'medication', 'procedure'][label % 3 + 1] AS cat FROM r JOIN embeddings e ON e.vec_id = q),
      g AS (SELECT *, CASE WHEN drug THEN cat = 'medication' AND tag = 'in' ELSE cat = 'condition' AND tag = 'disorder' OR cat = 'procedure' AND tag = 'procedure' END AS ok FROM j),
      s AS (SELECT *, round(CASE WHEN ok THEN least(k + 0.1, 1) WHEN drug AND cat = 'medication' THEN k * 0.9 WHEN drug THEN k * 0.5 WHEN cat = 'medication' THEN k ELSE k * 0.7 END, 6) AS s FROM g),
      b AS (SELECT q, arg_max(id, (s, -place)) AS id, max(s) AS s, arg_max(ok, (s, -place)) AS ok FROM s GROUP BY q), z AS (SELECT *, round(s::DECIMAL(18, 6), 3)::DOUBLE AS confidence FROM b)
      SELECT q, CASE WHEN s >= 0.9 THEN id END AS id, confidence, s >= 0.9 AND ok AS confirmed, s < 0.9 AS refused, CASE WHEN s < 0.9 THEN 'confidence ' || confidence || ' below threshold 0.90' END AS reason FROM z""",
    "n2_coverage": f"WITH {_COVERAGE} SELECT * FROM n2",
    "n2_missing": f"""WITH {_COVERAGE}, z AS (SELECT *, row_number() OVER (PARTITION BY note, priority ORDER BY line, kind, target) AS i FROM m WHERE kind IS NOT NULL AND NOT met)
      SELECT note, line, kind, priority, target, target_term, priority = 'high' AND i <= 5 OR priority = 'medium' AND i <= 3 AS suggested FROM z""",
    "n3_consistency": f"""WITH {_CONCEPTS}, {_TREE} SELECT note, 'negation' AS flag, 'error' AS severity, what FROM ({_NEGATED})
      UNION ALL SELECT DISTINCT note, 'tag', 'warning', lower(trim(term)) FROM c WHERE CASE category WHEN 'condition' THEN lower(mapped_term) NOT IN ('economy', 'standard', 'disorder') WHEN 'procedure' THEN lower(mapped_term) NOT IN ('promo', 'procedure') WHEN 'symptom' THEN lower(mapped_term) NOT IN ('economy', 'promo', 'standard') END
      UNION ALL SELECT a.note, 'parent', 'info', a.code || '>' || b.code FROM c a JOIN t ON t.c = a.line AND t.p > 0 JOIN c b ON b.note = a.note AND b.line = t.p WHERE a.line <> b.line""",
    "n4_specificity": f"WITH {_CONCEPTS}, {_SPECIFIC} SELECT * FROM n4",
    "n4_gaps": f"""WITH {_CONCEPTS}, {_SPECIFIC} SELECT note, rule_id, line, missing, present, 'Please clarify ' || term || ': ' || replace(missing, ',', ', ') || ' (documented: ' || CASE present WHEN '' THEN 'no details found' ELSE present END || ')' AS query FROM g WHERE missing <> ''""",
    "n5_note_report": f"""WITH {_COVERAGE.replace('m AS', 'mm AS').replace('FROM m ', 'FROM mm ')}, {_SPECIFIC}, mp AS (SELECT note, count(*) FILTER (confidence >= 0.9) AS m, count(*) AS n FROM c GROUP BY note), ng AS (SELECT DISTINCT note FROM ({_NEGATED}))
      SELECT note, round(round((m / n + coverage + CASE WHEN note IN (FROM ng) THEN 0.5 ELSE 1 END + specificity) / 4, 9)::DECIMAL(18, 9), 3)::DOUBLE AS overall,
        m || ' of ' || n || ' concepts mapped, ' || CASE WHEN note IN (FROM ng) THEN 'inconsistent' ELSE 'consistent' END AS summary FROM mp JOIN n2 USING (note) JOIN n4 USING (note)""",
    "n6_claim_validation": f"""WITH {_CLAIMS}, {_DOC_VECTORS}, {_VECTORS.format(n='cv', id='q', text='claim', table='cl')},
      h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM {_found('cv', 'true')} QUALIFY place <= 3),
      e AS (SELECT q, count(*) AS evidence, max(u) AS best FROM (SELECT q, round(score, 6) AS u FROM h) WHERE u > 0.2 GROUP BY q),
      nd AS (SELECT DISTINCT unnest({_KEYS.format(n=5)}) AS name FROM (SELECT {text._WORDS} AS w FROM conversations)),
      mt AS (SELECT q, unnest({_KEYS.format(n=3)}) AS concept FROM (SELECT q, {text._WORDS.replace('text', 'claim')} AS w FROM cl)),
      k AS (SELECT q, count(name) AS found, count(*) - count(name) AS missing FROM mt LEFT JOIN nd ON name = concept GROUP BY q),
      z AS (SELECT q, coalesce(evidence, 0) AS evidence, coalesce(best, 0) AS best, coalesce(found, 0) AS found, coalesce(missing, 0) AS missing FROM cl LEFT JOIN e USING (q) LEFT JOIN k USING (q))
      SELECT q, evidence, found, missing, best > 0.5 OR found > missing AS supported, round(round(CASE WHEN best > 0.5 THEN least(best + CASE WHEN found > 0 THEN 0.1 ELSE 0 END, 1) WHEN found > missing THEN least(0.4 + 0.1 * found, 1) WHEN found = 0 THEN 0.1 ELSE 0.25 END, 6)::DECIMAL(18, 6), 3)::DOUBLE AS confidence FROM z""",
    "v2_full_retrieval": f"""WITH {_DOC_VECTORS}, {_VECTORS.format(n='bv', id='item_id', text='text', table='benchmark')}, p AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM {_found('bv', 'true')}),
      a0 AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place, 0 AS tier FROM {_found('bv', "source = 'src0'")} QUALIFY place <= 2), a1 AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place, 1 AS tier FROM {_found('bv', "source = 'src1'")} QUALIFY place <= 2),
      s AS (SELECT q, id, round(len(list_intersect({_BAG % 'b.text'}, {_BAG % 'd.text'})) / len({_BAG % 'b.text'}), 9) AS s FROM p JOIN benchmark b ON item_id = q JOIN documents d ON doc_id = id WHERE place <= 15),
      a2 AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS place, 2 AS tier FROM s QUALIFY place <= 4), l AS (FROM a0 UNION ALL FROM a1 UNION ALL FROM a2), o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY tier, place) = 1)
      SELECT q, id, tier, row_number() OVER (PARTITION BY q ORDER BY tier, place, id) AS rank FROM o QUALIFY rank <= 8""",
    "v4_embedding": f"WITH {_DOC_VECTORS} SELECT id, b, round(v, 9) AS v FROM dv",
    "v6_ingest_status": """SELECT doc_id AS id, CASE WHEN text IS NULL THEN 'error' ELSE 'indexed' END AS status, CASE WHEN text IS NULL THEN 0 ELSE greatest(ceil((length(text) - 500) / 1500.0), 1)::BIGINT END AS chunks,
      CASE WHEN text IS NULL THEN 'no text' END AS error FROM documents""",
}
