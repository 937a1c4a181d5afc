"""Scans of file tables by patterns, lineage graphs from logs, statistics of load phases and migration of JSON columns."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import keywords


#: Folders that a census skips, and names that are their own extension.
SKIPPED = ["node_modules", ".git", "dist", "build", "out", ".next", "coverage", ".turbo", "target", "venv", ".venv", "__pycache__", "vendor", ".mypy_cache"]
NAMED = ["dockerfile", "makefile"]


@dataclass
class Pack:
    """Patterns of one kind of estate. systems: id -> patterns; imports: (pattern, system id); needs: workers only with one of these systems."""

    name: str
    systems: dict[str, list[str]]
    hints: list[str] = field(default_factory=list)
    imports: list[tuple[str, str]] = field(default_factory=list)
    needs: list[str] = field(default_factory=list)


def find_systems(files: DataFrame, packs: list[Pack]) -> DataFrame:
    """files(path, text) -> pack, system, files: how many files hold one of the patterns. Systems without any go; the earlier pack has an id."""
    first: dict[str, tuple[str, list[str]]] = {}
    for p in packs:
        for system, patterns in p.systems.items():
            first.setdefault(system, (p.name, patterns))
    counted = files.agg(*[F.count_if(F.col("text").rlike("|".join(f"(?:{x})" for x in patterns))).alias(s) for s, (_, patterns) in first.items()])
    rows = F.array(*[F.struct(F.lit(pack).alias("pack"), F.lit(s).alias("system"), F.col(f"`{s}`").alias("files")) for s, (pack, _) in first.items()])
    return counted.select(F.explode(rows).alias("r")).select("r.*").filter("files > 0")


def omitted_packs(files: DataFrame, packs: list[Pack], chosen: list[str]) -> DataFrame:
    """pack, systems: packs that a scan left out although files hold patterns of their systems (in the pack's order). Packs without a hit have no row."""
    left = [(p.name, s, patterns) for p in packs if p.name not in chosen for s, patterns in p.systems.items()]
    if not left:
        return files.sparkSession.createDataFrame([], "pack string, systems array<string>")
    hits = files.agg(*[F.bool_or(F.col("text").rlike("|".join(f"(?:{x})" for x in patterns))).alias(f"_{k}") for k, (_, _, patterns) in enumerate(left)])
    named = lambda pack: F.array_compact(F.array(*[F.when(F.col(f"_{k}"), s) for k, (name, s, _) in enumerate(left) if name == pack]))
    rows = F.array(*[F.struct(F.lit(pack).alias("pack"), named(pack).alias("systems")) for pack in dict.fromkeys(name for name, *_ in left)])
    return hits.select(F.explode(rows).alias("r")).select("r.*").filter(F.size("systems") > 0)


def census(files: DataFrame, skip: list[str] = SKIPPED, named: list[str] = NAMED, most: int | None = None) -> DataFrame:
    """files(path below the root) -> ext, n, total, truncated: files by lower-case extension.

    Files below a skipped or hidden folder do not count, nor names without a dot, but for those in ``named``, which are their own
    extension. With ``most``, the first so many files by path are counted, and truncated says whether there are more. Repeated paths count once, null paths never.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    barred = F.exists(folders, lambda x: x.isin(skip) | F.startswith(x, F.lit(".")))
    name = F.lower(F.element_at(parts, -1))
    ext = F.when(name.isin(named), name).when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
    rows = files.select("path").filter(F.col("path").isNotNull()).distinct().filter(~barred).select("path", ext.alias("ext")).filter("ext IS NOT NULL")
    seen = rows if most is None else rows.orderBy("path").limit(most)
    all_ = rows.agg(F.count("*").alias("_all"))
    counted = seen.groupBy("ext").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    # both right sides are one row
    return counted.join(F.broadcast(total), how="inner").join(F.broadcast(all_), how="inner").select("ext", "n", "total", (F.col("_all") > F.col("total")).alias("truncated"))


def find_workers(files: DataFrame, systems: DataFrame, packs: list[Pack], excluded: list[str]) -> DataFrame:
    """worker (stem), pack, path: files whose stem has a hint and no excluded part. A pack counts if it needs nothing or a system it needs was found; the earliest one, then the first path, stays."""
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    barred = reduce(lambda a, b: a | b, [F.contains("stem", F.lit(x)) for x in excluded], F.lit(False))
    rules = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(p.name).alias("pack"), F.array(*map(F.lit, p.hints)).cast("array<string>").alias("hints")) for i, p in enumerate(packs)])
    named = files.select("path", stem.alias("stem")).filter(~barred).select("path", "stem", F.explode(rules).alias("r")).select("path", "stem", "r.place", "r.pack", "r.hints")
    hinted = named.filter(F.exists("hints", lambda h: F.contains(F.col("stem"), h)))
    free = [p.name for p in packs if not p.needs]
    needs = F.explode(F.array(*[F.struct(F.lit(p.name).alias("pack"), F.lit(s).alias("system")) for p in packs for s in p.needs] or [F.struct(F.lit("").alias("pack"), F.lit("").alias("system"))]))
    open_packs = systems.select("system").withColumn("n", needs).filter("system = n.system").select("n.pack").distinct().withColumn("_open", F.lit(True))
    kept = hinted.join(open_packs, "pack", "left").filter(F.col("pack").isin(free) | F.col("_open"))
    return kept.groupBy(F.col("stem").alias("worker")).agg(F.min(F.struct("place", "path", "pack")).alias("b")).select("worker", "b.pack", "b.path")


def find_flows(files: DataFrame, workers: DataFrame, systems: DataFrame, packs: list[Pack]) -> DataFrame:
    """worker, system: systems found that a worker's import lines name."""
    table = F.array(*[F.struct(F.lit(p.name).alias("pack"), F.lit(x).alias("pattern"), F.lit(s).alias("system")) for p in packs for x, s in p.imports])
    lines = workers.join(files.select("path", "text"), "path").select("worker", "pack", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("line", F.trim("line")).filter(F.col("line").rlike(r"^(from|import) ")).distinct()
    hit = F.filter(table, lambda t: (t["pack"] == F.col("pack")) & F.call_function("regexp_like", F.col("line"), t["pattern"]))
    return lines.select("worker", F.explode(hit).alias("t")).select("worker", F.col("t.system").alias("system")).distinct().join(systems.select("system"), "system", "left_semi").select("worker", "system")


def lineage(turns: DataFrame, cards: DataFrame, used: DataFrame, diagrams: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(session, text), cards(card, session, text), used(session, rid), diagrams(diagram, session), entries(entry, card) -> nodes(id, label), edges(src, dst, type).

    Sessions discuss three concepts a turn, cards mention five, entries are about what their card mentions. Retrieved ids
    ``memory:<card>`` are context of a session. Edges whose ends are not among the nodes go; each is kept once.
    """
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edge = lambda rows, a, b, t: rows.select(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"))
    concept = lambda n: F.explode(keywords(F.col("text"), n)).alias("concept")
    discussed = turns.select("session", concept(3)).distinct()
    mentioned = cards.select("card", concept(5)).distinct()
    about = entries.join(mentioned, "card").select("entry", "concept")
    context = used.filter(F.startswith("rid", F.lit("memory:"))).select("session", F.regexp_replace("rid", "^memory:", "").alias("card"))
    known = [("session", turns, "session"), ("card", cards, "card"), ("diagram", diagrams, "diagram"), ("entry", entries, "entry"), ("concept", discussed, "concept"), ("concept", mentioned, "concept")]
    nodes = reduce(DataFrame.unionByName, [df.select(node(kind, c).alias("id"), F.lit(kind).alias("label")) for kind, df, c in known]).distinct()
    parts = [
        edge(discussed, node("session", "session"), node("concept", "concept"), "DISCUSSES"), edge(mentioned, node("card", "card"), node("concept", "concept"), "MENTIONS"),
        edge(about, node("entry", "entry"), node("concept", "concept"), "ABOUT"), edge(entries, node("entry", "entry"), node("card", "card"), "CURATED_FROM"),
        edge(context, node("session", "session"), node("card", "card"), "USED_CONTEXT"), edge(cards, node("session", "session"), node("card", "card"), "PROPOSED"),
        edge(diagrams, node("session", "session"), node("diagram", "diagram"), "PRODUCED"),
    ]
    edges = reduce(DataFrame.unionByName, parts).distinct()
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def phase_stats(phases: dict[str, DataFrame]) -> DataFrame:
    """phase, rows, status (complete or empty) of each phase of a load."""
    rows = [df.agg(F.lit(name).alias("phase"), F.count("*").alias("rows")) for name, df in phases.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("status", F.when(F.col("rows") > 0, "complete").otherwise("empty"))


def run_phases(phases: dict[str, DataFrame], path: str) -> list[dict]:
    """Writes each phase under the path; rows are counted while they are written. A failing phase is recorded and ends the run."""
    out: list[dict] = []
    for name, df in phases.items():
        seen, began = Observation(name), time.time()
        stats = {"phase": name, "rows": 0, "status": "complete", "error": None}
        try:
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}")
            stats["rows"] = seen.get["rows"]
            stats["status"] = "complete" if stats["rows"] else "empty"
        except Exception as e:  # recorded, and nothing after it runs
            stats |= {"status": "error", "error": str(e)[:500]}
        out.append(stats | {"seconds": round(time.time() - began, 3)})
        if stats["status"] == "error":
            break
    return out


def migrated(rows: DataFrame, done: DataFrame, key: str, body: str, schema: str, times: list[str]) -> DataFrame:
    """Rows whose key ``done`` lacks, with the fields of their JSON text; zoned ISO times become naive ones in UTC. Text that is no JSON gives nulls."""
    fresh = rows.join(done.select(key), key, "left_anti").dropDuplicates([key]).select(key, F.from_json(body, schema).alias("_j")).select(key, "_j.*")
    naive = lambda c: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(c).cast("timestamp_ntz"))
    return fresh.withColumns({c: naive(F.col(c)) for c in times})
