"""Case-mix queries: suppliers stand for hospitals, parts for DRGs, line items for their cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import FACILITIES
from ..operators import casemix as cm
from ..operators import records as rc
from ..operators import tables as tb
from .base import table

#: Facility types of a directory.
KINDS = {"0": "ACUTE", "1": "CRITICAL", "2": "CHILDREN"}


def _mix(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("provider"), F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("drg")).agg(F.sum("l_quantity").alias("discharges"))


def _weights(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("drg"), (F.col("p_retailprice") / 1000).alias("weight"))


def _directory(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    kind = (F.col("s_suppkey") % 3).cast("string")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("provider"), F.col("s_name").alias("name"), F.col("n_name").alias("state"), kind.alias("type"))


def _cmi(spark, d):
    return cm.case_mix_index(_mix(spark, d), _weights(spark, d))


def a3(spark, d):
    return _cmi(spark, d)


def a4(spark, d):
    return cm.peer_percentiles(_cmi(spark, d), _directory(spark, d))


def a5(spark, d):
    return cm.percentile_rank(_cmi(spark, d), _directory(spark, d))


def a6(spark, d):
    return cm.benchmark(_cmi(spark, d), _directory(spark, d))


def a7(spark, d):
    return rc.type_counts(_directory(spark, d), "type")


def a8(spark, d):
    p = table(spark, d, "part")
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_distinct("p_brand").alias("brands"), F.max("p_retailprice").alias("top"), F.round(F.percentile("p_retailprice", F.lit(0.5)), 6).alias("median"))


def _titles(spark, d):
    mark = F.element_at(F.array(*map(F.lit, [" WITH MCC", " WITH CC", " WITHOUT CC/MCC", ""])), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select("p_partkey", F.concat(F.col("p_type"), mark).alias("title"), F.round(F.col("p_retailprice") / 1000, 4).alias("weight"))


def a10(spark, d):
    return cm.severity_shifts(_titles(spark, d).select("title", "weight"))


def _cases(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("grp"), F.col("l_partkey").alias("drg"))


def a9(spark, d):
    both = [cm.case_list_cmi(_cases(spark, d), _weights(spark, d), "grp", w, places=10).withColumn("weighted", F.lit(w)) for w in (False, True)]
    return both[0].unionByName(both[1])


def w2(spark, d):
    rows = table(spark, d, "part").select("p_type", "p_brand", "p_partkey", "p_name")
    return cm.lowest_by(rows, ["p_type", "p_brand"], "p_partkey")


def w4(spark, d):
    return cm.latest(_cmi(spark, d), "year")


def j5(spark, d):
    known = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return tb.split_known(table(spark, d, "lineitem").select("l_suppkey"), known, "l_suppkey")


def j8(spark, d):
    rows = _directory(spark, d).join(cm.latest(_cmi(spark, d), "year"), "provider", "left")
    order = [F.desc_nulls_last("cmi"), F.desc_nulls_last("discharges"), F.col("name")]
    return cm.same_area(rows, "state", "provider", order, 3)


def j9(spark, d):
    cmi = cm.latest(_cmi(spark, d), "year").select("provider", "cmi", "discharges")
    rows = table(spark, d, "supplier").filter(F.col("s_name").rlike("(?i)(1|7)$")).withColumnRenamed("s_suppkey", "provider")
    return rows.join(cmi, "provider", "left").select("provider", "s_name", "cmi", F.round(F.try_divide(F.col("s_acctbal"), F.col("discharges")), 6).alias("ratio"))


def p2(spark, d):
    from ..functions.scalars import severity

    return _titles(spark, d).select("p_partkey", severity(F.col("title")).alias("s")).select("p_partkey", F.col("s.base").alias("base"), F.col("s.status").alias("status"))


def p3(spark, d):
    from ..functions.scalars import lookup

    kinds = F.array(*[F.lit(k) for k in [*FACILITIES, "Unknown Kind"]])
    named = F.concat(F.lit(" "), F.element_at(kinds, (F.col("s_suppkey") % 10 + 1).cast("int")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("provider"), lookup(named, FACILITIES, "OTHER").alias("facility"))


def w8(spark, d):
    """By id, name, city (the state stands for it) or alias."""
    rows = _directory(spark, d).join(cm.latest(_cmi(spark, d), "year").select("provider", "discharges"), "provider", "left")
    rows = rows.withColumn("aliases", F.array(F.concat((F.col("provider") % 7).cast("string"), F.lit("-Clinic"))))
    return rc.name_search(rows, "1", city="state").select("provider", "name", "state", "rank", "discharges")


QUERIES = {
    "a3_case_mix_index": a3, "a4_peer_percentiles": a4, "a5_percentile_rank": a5, "a6_hospital_benchmark": a6, "a7_type_counts": a7, "a8_dataset_info": a8,
    "a9_case_list_cmi": a9, "a10_severity_shifts": a10, "w2_lowest_drg": w2, "w4_latest_vintage": w4, "w8_ranked_name_search": w8, "j5_known_keys": j5, "j8_same_area_peers": j8,
    "j9_hospital_examples": j9, "p2_severity_split": p2, "p3_facility_class": p3,
}

_CTE = """
mix AS (SELECT l_suppkey AS provider, year(l_shipdate)::INT AS year, l_partkey AS drg, sum(l_quantity) AS discharges FROM lineitem GROUP BY ALL),
cmi AS (SELECT provider, year, round(sum(p_retailprice / 1000 * discharges) / nullif(sum(discharges), 0), 4) AS cmi, sum(discharges) AS discharges,
               count(DISTINCT drg) AS n_drgs FROM mix JOIN part ON p_partkey = drg GROUP BY ALL),
dir AS (SELECT s_suppkey AS provider, s_name AS name, n_name AS state, (s_suppkey % 3)::VARCHAR AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey),
peer AS (SELECT * FROM cmi JOIN dir USING (provider) WHERE cmi IS NOT NULL AND discharges >= 100),
last AS (SELECT * FROM cmi WHERE year = (SELECT max(year) FROM cmi)),
titles AS (SELECT p_partkey, p_type, p_size % 4 AS k, round(p_retailprice / 1000, 4) AS weight FROM part),
ranks AS (SELECT c.provider, c.year, d.state, c.cmi,
    CAST(round_even(100.0 * (SELECT count(*) FROM peer p WHERE p.cmi <= c.cmi) / nullif((SELECT count(*) FROM peer), 0), 0) AS INT) AS "national",
    CAST(round_even(100.0 * (SELECT count(*) FROM peer p WHERE p.state = d.state AND p.cmi <= c.cmi) / nullif((SELECT count(*) FROM peer p WHERE p.state = d.state), 0), 0) AS INT) AS in_state
  FROM cmi c JOIN dir d USING (provider) WHERE c.cmi IS NOT NULL),
pct AS (SELECT CASE WHEN grouping(state) = 1 THEN 0 WHEN grouping(type) = 1 THEN 1 ELSE 2 END AS level, state, type, count(*) AS n,
    round(quantile_cont(cmi, 0.10), 6) AS p10, round(quantile_cont(cmi, 0.25), 6) AS p25, round(quantile_cont(cmi, 0.50), 6) AS median,
    round(quantile_cont(cmi, 0.75), 6) AS p75, round(quantile_cont(cmi, 0.90), 6) AS p90, sum(discharges) AS discharges
  FROM peer GROUP BY GROUPING SETS ((), (state), (state, type)))
"""

ORACLE = {
    "a3_case_mix_index": f"WITH {_CTE} SELECT * FROM cmi",
    "a4_peer_percentiles": f"WITH {_CTE} SELECT * FROM pct",
    "a5_percentile_rank": f"WITH {_CTE} SELECT * FROM ranks",
    "a6_hospital_benchmark": f"""WITH {_CTE} SELECT c.provider, c.year, d.name, d.state, c.cmi, c.discharges, p.median AS state_median, p.n AS state_n, r."national", r.in_state,
        round(p.median - c.cmi, 4) AS gap, round(round(p.median - c.cmi, 4) * c.discharges * 7200.0, 2) AS revenue_gap
      FROM cmi c JOIN dir d USING (provider) LEFT JOIN (SELECT * FROM pct WHERE level = 1) p ON p.state = d.state LEFT JOIN ranks r ON r.provider = c.provider AND r.year = c.year""",
    "a7_type_counts": f"WITH {_CTE} SELECT type, count(*) AS n FROM dir GROUP BY type",
    "a8_dataset_info": "SELECT count(*) AS n, count(*) FILTER (p_size > 25) AS large, count(DISTINCT p_brand) AS brands, max(p_retailprice) AS top, round(quantile_cont(p_retailprice, 0.5), 6) AS median FROM part",
    "a9_case_list_cmi": """WITH c AS (SELECT l_orderkey % 100 AS grp, l_partkey AS drg FROM lineitem), w AS (SELECT p_partkey AS drg, p_retailprice / 1000 AS weight FROM part)
      SELECT grp, round(avg(weight), 10) AS cmi, count(*) AS n, false AS weighted FROM (SELECT DISTINCT * FROM c) JOIN w USING (drg) GROUP BY grp
      UNION ALL SELECT grp, round(avg(weight), 10), count(*), true FROM c JOIN w USING (drg) GROUP BY grp""",
    "a10_severity_shifts": f"""WITH {_CTE}, m AS (SELECT p_type, min(weight) FILTER (k = 2) AS n, min(weight) FILTER (k = 1) AS c, min(weight) FILTER (k = 0) AS m FROM titles GROUP BY p_type)
      SELECT count(*) AS triplets, round(avg(c - n), 4) AS none_cc, round(avg(m - c), 4) AS cc_mcc, round(avg(m - n), 4) AS none_mcc FROM m WHERE n IS NOT NULL AND c IS NOT NULL AND m IS NOT NULL""",
    "w2_lowest_drg": "SELECT p_type, p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_type, p_brand",
    "w4_latest_vintage": f"WITH {_CTE} SELECT * FROM last",
    "w8_ranked_name_search": f"""WITH {_CTE} SELECT d.provider, name, state, CASE WHEN d.provider = 1 THEN 0 WHEN d.provider % 7 = 1 THEN 1 ELSE 2 END AS rank, discharges
      FROM dir d LEFT JOIN last USING (provider) WHERE contains(lower(name), '1') OR d.provider = 1 OR d.provider % 7 = 1 ORDER BY rank, discharges DESC NULLS LAST, name LIMIT 20""",
    "j5_known_keys": "SELECT count(*) FILTER (s_suppkey IS NOT NULL) AS loaded, count(*) FILTER (s_suppkey IS NULL) AS skipped FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON l_suppkey = s_suppkey",
    "j8_same_area_peers": f"""WITH {_CTE}, o AS (SELECT d.provider, d.state, d.name, cmi, discharges FROM dir d LEFT JOIN last USING (provider)),
      p AS (SELECT a.provider AS anchor, b.provider AS peer, row_number() OVER (PARTITION BY a.provider ORDER BY b.cmi DESC NULLS LAST, b.discharges DESC NULLS LAST, b.name) AS place FROM o a JOIN o b ON a.state = b.state AND a.provider <> b.provider)
      SELECT * FROM p WHERE place <= 3""",
    "j9_hospital_examples": f"WITH {_CTE} SELECT s_suppkey AS provider, s_name, cmi, round(s_acctbal / nullif(discharges, 0), 6) AS ratio FROM supplier LEFT JOIN last ON provider = s_suppkey WHERE s_name LIKE '%1' OR s_name LIKE '%7'",
    "p2_severity_split": "SELECT p_partkey, p_type AS base, CASE p_size % 4 WHEN 0 THEN 'MCC' WHEN 1 THEN 'CC' WHEN 2 THEN 'NONE' END AS status FROM part",
    "p3_facility_class": "SELECT s_suppkey AS provider, ['IPPS', 'CAH', 'PSYCH', 'PEDS', 'VA', 'DOD', 'REH', 'LTCH', 'PCH', 'OTHER'][s_suppkey % 10 + 1] AS facility FROM supplier",
}
