"""Case mix: index, peer percentiles, benchmark, severity shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity

LEVELS = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def case_mix_index(mix: DataFrame, weights: DataFrame) -> DataFrame:
    """mix(provider, year, drg, discharges), weights(drg, weight) -> provider, year, cmi, discharges, n_drgs; cmi is null without discharges.

    The index is rounded half up to four places, after twelve: a sum's last bits depend on the order of its rows, and would move an exact tie either way.
    """
    joined = mix.join(weights, "drg")
    cmi = F.round(F.try_divide(F.sum(F.col("weight") * F.col("discharges")), F.sum("discharges")), 12)
    return joined.groupBy("provider", "year").agg(F.round(cmi, 4).alias("cmi"), F.sum("discharges").alias("discharges"), F.count_distinct("drg").alias("n_drgs"))


def peers(cmi: DataFrame, least: float = 100) -> DataFrame:
    return cmi.filter(F.col("cmi").isNotNull() & (F.col("discharges") >= least))


def peer_percentiles(cmi: DataFrame, directory: DataFrame, least: float = 100) -> DataFrame:
    """One row for all, each state, and each state and type: count, exact percentiles, discharges; level 0 all, 1 state, 2 state and type."""
    rows = peers(cmi, least).join(directory, "provider")
    aggs = [F.count("*").alias("n"), *[F.round(F.percentile("cmi", F.lit(p)), 6).alias(k) for k, p in LEVELS.items()], F.sum("discharges").alias("discharges")]
    sets = [[], [F.col("state")], [F.col("state"), F.col("type")]]
    grouped = rows.groupingSets(sets, F.col("state"), F.col("type")).agg(F.grouping_id().alias("g"), *aggs)
    level = F.when(F.col("g") == 0, 2).when(F.col("g") == 1, 1).otherwise(0)
    return grouped.select(level.alias("level"), "state", "type", "n", *LEVELS, "discharges")


def percentile_rank(cmi: DataFrame, directory: DataFrame, least: float = 100) -> DataFrame:
    """Whole per cent of peers at or below each provider's index, in all and in its state. The provider itself may have too few discharges.

    Ranks come from running counts over the distinct index values (rounded to four places, so their number is
    bounded), not from comparing each provider with each peer.
    """
    rows = cmi.filter(F.col("cmi").isNotNull()).join(directory.select("provider", "state"), "provider")
    out = rows
    for name, keys in (("national", []), ("in_state", ["state"])):
        member = F.when(F.col("discharges") >= least, 1).otherwise(0)
        counts = rows.groupBy(*keys, "cmi").agg(F.sum(member).alias("n"))
        part = Window.partitionBy(*keys) if keys else Window.partitionBy()
        upto = F.sum("n").over(part.orderBy("cmi"))
        total = F.sum("n").over(part)
        share = counts.select(*keys, "cmi", F.bround(F.try_divide(100 * upto, total), 0).cast("int").alias(name))
        out = out.join(share, [*keys, "cmi"])
    return out.select("provider", "year", "state", "cmi", "national", "in_state")


def benchmark(cmi: DataFrame, directory: DataFrame, base_rate: float = 7200.0, least: float = 100) -> DataFrame:
    """Each provider with its state's median, the gap to it, and what closing the gap is worth."""
    ranks = percentile_rank(cmi, directory, least).drop("cmi", "state")
    stats = peer_percentiles(cmi, directory, least).filter("level = 1").select("state", F.col("median").alias("state_median"), F.col("n").alias("state_n"))
    gap = F.round(F.col("state_median") - F.col("cmi"), 4)
    rows = cmi.join(directory, "provider").join(stats, "state", "left").join(ranks, ["provider", "year"], "left")
    return rows.select(
        "provider", "year", "name", "state", "cmi", "discharges", "state_median", "state_n", "national", "in_state",
        gap.alias("gap"), F.round(gap * F.col("discharges") * base_rate, 2).alias("revenue_gap"),
    )


def same_area(rows: DataFrame, area: str, key: str, order: list[Column], n: int) -> DataFrame:
    """For every anchor the first n others of its area. Only the first n + 1 of an area are ever joined."""
    w = Window.partitionBy(area).orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(w))
    top = ranked.filter(F.col("_r") <= n + 1).select(area, F.col(key).alias("peer"), F.col("_r").alias("_p"))
    pairs = ranked.select(area, F.col(key).alias("anchor"), "_r").join(top, area).filter("anchor <> peer")
    place = F.col("_p") - F.when(F.col("_p") > F.col("_r"), 1).otherwise(0)
    return pairs.select("anchor", "peer", place.alias("place")).filter(F.col("place") <= n)


def lowest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the lowest value in each group."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")


def latest(rows: DataFrame, year: str) -> DataFrame:
    """Rows of the last year there is."""
    return rows.join(F.broadcast(rows.agg(F.max(year).alias(year))), year)  # one row


def severity_shifts(weights: DataFrame) -> DataFrame:
    """weights(title, weight): mean differences between severities over bases that have all three."""
    parts = weights.select(severity(F.col("title")).alias("s"), "weight").select("s.base", "s.status", "weight")
    wide = parts.groupBy("base").pivot("status", ["NONE", "CC", "MCC"]).agg(F.min("weight")).dropna(subset=["NONE", "CC", "MCC"])
    mean = lambda a, b: F.round(F.avg(F.col(b) - F.col(a)), 4)
    return wide.agg(F.count("*").alias("triplets"), mean("NONE", "CC").alias("none_cc"), mean("CC", "MCC").alias("cc_mcc"), mean("NONE", "MCC").alias("none_mcc"))


def case_list_cmi(cases: DataFrame, weights: DataFrame, group: str, weighted: bool, places: int = 4) -> DataFrame:
    """Mean weight of the groups' DRGs: each once, or once a case."""
    rows = cases.select(group, "drg") if weighted else cases.select(group, "drg").distinct()
    return rows.join(weights, "drg").groupBy(group).agg(F.round(F.avg("weight"), places).alias("cmi"), F.count("*").alias("n"))


#: Mean weight differences between severities.
SHIFTS = {("NONE", "CC"): 0.5038, ("NONE", "MCC"): 1.8111, ("CC", "MCC"): 1.3188}


def gap_impact(gaps: DataFrame, designations: DataFrame, weights: DataFrame, rate: float = 7200.0) -> DataFrame:
    """gaps(gap_id, base, current, codes), designations(code, designation), weights(base, status, weight) -> gap_id, kind, target_code, weight_delta, revenue.

    A base with weights of two severities gives a principal impact; any other gap goes by the best designation among its
    codes against the current code's; without a gain the kind is 'none' and the rest is null.
    """
    named = designations.select("code", "designation")
    codes = gaps.select("gap_id", F.posexplode("codes").alias("pos", "code")).join(named, "code", "left")
    at = lambda name: F.min_by("code", F.when(F.col("designation") == name, F.col("pos")))
    found = codes.groupBy("gap_id").agg(F.min_by("code", "pos").alias("first"), at("MCC").alias("mcc_code"), at("CC").alias("cc_code"))
    wide = weights.groupBy("base").pivot("status", ["NONE", "NOT_MCC", "CC", "MCC"]).agg(F.min("weight"))
    rows = gaps.join(found, "gap_id", "left").join(wide, "base", "left").join(named.select(F.col("code").alias("current"), F.col("designation").alias("_now")), "current", "left")
    step = lambda names: F.coalesce(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("status"), F.col(n).alias("weight"))) for n in names])
    rows = rows.withColumns({"_low": step(["NONE", "NOT_MCC", "CC"]), "_high": step(["MCC", "CC"])})
    mapped = F.coalesce(F.col("_low.status") != F.col("_high.status"), F.lit(False))
    best = F.when(F.col("mcc_code").isNotNull(), "MCC").when(F.col("cc_code").isNotNull(), "CC")
    now = F.coalesce("_now", F.lit("NONE"))
    shift = F.coalesce(*[F.when((now == a) & (best == b), F.lit(v)) for (a, b), v in SHIFTS.items()])
    goal = F.when(mapped, F.col("_high.status")).otherwise(best)
    code = F.coalesce(F.when(goal == "MCC", F.col("mcc_code")).when(goal == "CC", F.col("cc_code")), F.col("first"))
    delta = F.round(F.when(mapped, F.col("_high.weight") - F.col("_low.weight")).otherwise(shift), 4)
    kind = F.when(mapped, "principal").when(shift.isNotNull(), "comorbidity").otherwise("none")
    out = rows.select("gap_id", kind.alias("kind"), F.when(mapped | shift.isNotNull(), code).alias("target_code"), delta.alias("weight_delta"))
    return out.withColumn("revenue", F.round(F.col("weight_delta") * rate, 2))
