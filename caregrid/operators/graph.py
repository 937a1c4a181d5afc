"""Graph tables: nodes and edges as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edge_type
from .store import written

HUB = 1 << 16
#: Seeds of a group, and steps from a group's frontier that one task takes.
SEEDS = 1 << 10
STEPS = 1 << 20


def ancestors(edges: DataFrame, depth: int, paths: bool = False) -> DataFrame:
    """edges(child, parent) -> node, ancestor, distance for up to 1..5 steps: the least distance of a pair, or a row a path."""
    depth = max(1, min(depth, 5))
    step = edges.select(F.col("child").alias("_from"), F.col("parent").alias("_to"))
    level = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out = level = level if paths else level.distinct()
    for k in range(2, depth + 1):
        level = level.join(step, F.col("ancestor") == F.col("_from")).select("node", F.col("_to").alias("ancestor"), F.lit(k).alias("distance"))
        level = level if paths else level.distinct()
        out = out.unionByName(level)
    return out if paths else out.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))


def descendants(edges: DataFrame, depth: int) -> DataFrame:
    back = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return ancestors(back, depth).withColumnRenamed("ancestor", "descendant")


class _Steps:
    """Written undirected steps (src, dst, _p): the neighbours of a node of more than ``hub`` edges lie in parts by a hash, each joined on its own key."""

    def __init__(self, edges: DataFrame, hub: int) -> None:
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        self.rows = written(both.filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
        self.degrees = written(self.rows.groupBy("src").agg(F.count("*").alias("_d")).withColumn("_m", F.ceil(F.col("_d") / hub).cast("int")), "degrees")
        self.hubs = written(self.degrees.filter("_m > 1").select("src", "_m"), "hubs")
        self.parted = self._cut(self.rows).withColumn("_p", F.pmod(F.xxhash64("dst"), F.col("_m")).cast("int")).drop("_m")

    def _cut(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.hubs), "src", "left").withColumn("_m", F.coalesce("_m", F.lit(1)))  # a row for ``hub`` edges at most

    def of(self, asked: DataFrame) -> DataFrame:
        """asked(src and others) with each dst."""
        return self._cut(asked).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m").join(self.parted, ["src", "_p"]).drop("_p")


def _seed_groups(seeds: DataFrame) -> DataFrame:
    """_g, seed, node (the seed): different seeds in order of length and name, in groups of about SEEDS, as a written table."""
    own = written(seeds.select("node").filter("node IS NOT NULL").distinct(), "asked")
    groups = -(-own.count() // SEEDS) or 1
    return written(own.repartitionByRange(groups, F.length(F.col("node").cast("string")), "node").select(F.spark_partition_id().alias("_g"), F.col("node").alias("seed"), "node"), "seeds")


def _reached(group: pa.Table) -> pa.Table:
    """Rows of one group and part of the nodes: steps (mid, dst), frontier (seed, mid) and seen (seed, dst) -> the pairs (seed, dst) one step on that were not seen."""
    kind = group["kind"].to_numpy()
    code = lambda columns: pc.dictionary_encode(pa.chunked_array([c for x in columns for c in group[x].chunks])).combine_chunks()
    seeds, ends = code(["seed"]), code(["mid", "dst"])
    places = lambda x: x.indices.fill_null(0).to_numpy().astype(np.int64)
    seed, (mid, dst) = places(seeds), places(ends).reshape(2, -1)
    step, front, seen = (np.flatnonzero(kind == k) for k in range(3))
    front = front[np.argsort(mid[front], kind="stable")]
    first, last = (np.searchsorted(mid[front], mid[step], side) for side in ("left", "right"))
    many, found = last - first, np.zeros(0, np.int64)
    cuts = np.searchsorted(np.cumsum(many), np.arange(STEPS, many.sum() + STEPS, STEPS), "right")
    for a, z in zip([0, *cuts[:-1].tolist()], [*cuts[:-1].tolist(), len(step)]):
        n = many[a:z]
        at = np.repeat(first[a:z] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.union1d(found, seed[front[at]] * len(ends.dictionary) + np.repeat(dst[step[a:z]], n))
    found = np.setdiff1d(found, seed[seen] * len(ends.dictionary) + dst[seen], assume_unique=False)
    g = pa.array(np.full(len(found), group["_g"][0].as_py(), np.int32))
    if not len(found):
        return pa.table([g, pa.array([], seeds.dictionary.type), pa.array([], ends.dictionary.type)], ["_g", "seed", "node"])
    return pa.table([g, seeds.dictionary.take(pa.array(found // len(ends.dictionary))), ends.dictionary.take(pa.array(found % len(ends.dictionary)))], ["_g", "seed", "node"])


def _onward(front: DataFrame, seen: DataFrame, steps: _Steps) -> DataFrame:
    """front(_g, seed, node), seen(_g, seed, node) -> _g, seed, node: what lies one step beyond the frontier and was not seen.

    A node's steps travel once for a group of seeds, not once a seed, and seeds that lie together tend to meet the same nodes. A group's work is cut
    by a hash of the nodes reached, so that a task takes about STEPS steps, and each (seed, node) is made in one task.
    """
    front = front.select("_g", "seed", F.col("node").alias("src"))
    size = front.join(steps.degrees.select("src", "_d"), "src").groupBy("_g").agg(F.ceil(F.sum("_d") / STEPS).cast("int").alias("_k"))
    size = written(size, "sizes")
    part = lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.col("_k")).cast("int").alias("_b")
    lists = steps.of(front.select("_g", "src").distinct().join(size, "_g"))
    none = lambda c, rows: F.lit(None).cast(rows.schema[c].dataType)
    rows = lists.select("_g", part("dst"), F.lit(0).alias("kind"), none("seed", front).alias("seed"), F.col("src").alias("mid"), "dst")
    every = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_b")
    rows = rows.unionByName(front.join(size, "_g").select("_g", every, F.lit(1).alias("kind"), "seed", F.col("src").alias("mid"), none("dst", lists).alias("dst")))
    rows = rows.unionByName(seen.join(size, "_g").select("_g", part("node"), F.lit(2).alias("kind"), "seed", none("src", front).alias("mid"), F.col("node").alias("dst")))
    rows = written(rows, "dealt")  # the shuffles of the joins go before the groups are dealt
    return rows.groupBy("_g", "_b").applyInArrow(_reached, f"_g int, seed {seen.schema['seed'].dataType.simpleString()}, node {lists.schema['dst'].dataType.simpleString()}")


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, hub: int = HUB) -> DataFrame:
    """edges(src, dst), seeds(node) -> seed, node, distance within 1..3 undirected steps, each node once a seed.

    Each frontier but the last is a written table, so that no hop is computed twice, and the search ends at an empty one. The
    last one is the largest by far and is made where it is read. The neighbours of a node of more than ``hub`` edges lie in parts by a hash.
    """
    depth, steps = max(1, min(depth, 3)), _Steps(edges, hub)
    seen = front = _seed_groups(seeds)
    out = None
    for k in range(1, depth + 1):
        front = _onward(front, seen, steps)
        front = front if k == depth else written(front, "frontier")
        found = front.select("seed", "node", F.lit(k).alias("distance"))
        out = found if out is None else out.unionByName(found)
        if k < depth and front.isEmpty():
            break
        seen = seen.unionByName(front)
    return out


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("node")
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def checked_edges(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, order: str) -> DataFrame:
    """Edges whose ends exist; of equal (src, dst, type) the last by ``order``."""
    ok = edges.join(src_nodes.select(F.col("node").alias("src")), "src", "left_semi").join(dst_nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    return ok.groupBy("src", "dst", "type").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select("src", "dst", "type", "_row.*")


def size_by_type(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    nodes = ends.agg(F.lit("nodes").alias("what"), F.count_distinct("node").alias("n"))
    return edges.groupBy(F.concat(F.lit("edges:"), F.col("type")).alias("what")).agg(F.count("*").alias("n")).unionByName(nodes)


def graph_size(nodes: DataFrame, edges: DataFrame, membership: list[str], vectors: DataFrame) -> DataFrame:
    """what, n: nodes(node), edges(src, dst, type), edges of other types than ``membership``, and vectors(source) by source. Nothing to count is 0, a null source its own."""
    count = lambda rows, name: rows.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    inner = F.count_if(F.coalesce(~F.col("type").isin(membership), F.lit(True)))
    both = edges.agg(F.count("*").alias("edges"), inner.alias("relations")).select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("edges", "relations")])))
    by = vectors.groupBy(F.concat(F.lit("vectors:"), F.coalesce("source", F.lit(""))).alias("what")).agg(F.count("*").alias("n"))
    return count(nodes.select("node").distinct(), "nodes").unionByName(both).unionByName(by)


def typed_edges(edges: DataFrame, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with their type trimmed and in upper case; and those whose type is not among ``allowed`` (without it: is not well formed), as they came, with the reason."""
    clean = edge_type(F.col("type"))
    ok = clean.isNotNull() if allowed is None else F.coalesce(clean.isin(allowed), F.lit(False))
    reason = F.when(F.col("type").isNull(), "no type").when(clean.isNull(), "malformed").otherwise("unknown")
    return edges.filter(ok).withColumn("type", clean), edges.filter(~ok).withColumn("reason", reason)


def degree_ranking(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Nodes by number of undirected edges, those without any included."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    counted = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def cooccurrence(mentions: DataFrame, n: int) -> DataFrame:
    """mentions(artifact, concept) -> unordered pairs by number of artifacts. An artifact has a bounded number of concepts."""
    m = mentions.select("artifact", "concept").distinct()
    pairs = m.withColumnRenamed("concept", "a").join(m.withColumnRenamed("concept", "b"), "artifact").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("artifacts")).orderBy(F.desc("artifacts"), "a", "b").limit(n)


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """Nodes unique by id: the last value of each property that is not null."""
    rest = [c for c in nodes.columns if c not in ("node", order)]
    return nodes.groupBy("node").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def node_names(nodes: DataFrame) -> DataFrame:
    """nodes(id, name, text, card_id) -> id, label: the first of name, text, card id and id that is not null."""
    return nodes.select("id", F.coalesce("name", "text", F.col("card_id").cast("string"), F.col("id").cast("string")).alias("label"))


def diagram_rows(diagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """diagrams(diagram_id, code) -> nodes(diagram_id, id, label), edges(diagram_id, src, dst, label); first definitions win."""
    lines = diagrams.select("diagram_id", F.posexplode(F.split("code", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").rlike(r"^(%%|graph\b|flowchart\b)"))
    shape = r"([A-Za-z0-9_]+)(?:\[\(|\(\[|\(\(|\[|\(|\{)([^\[\](){}]+)(?:\)\]|\]\)|\)\)|\]|\)|\})"
    hits = F.arrays_zip(F.regexp_extract_all("line", F.lit(shape), F.lit(1)).alias("id"), F.regexp_extract_all("line", F.lit(shape), F.lit(2)).alias("label"))
    defined = lines.select("diagram_id", "pos", F.posexplode(hits).alias("k", "h")).select("diagram_id", F.col("h.id").alias("id"), F.col("h.label").alias("label"), (F.col("pos") * 1000 + F.col("k")).alias("at"))
    bare = F.regexp_replace("line", r"(?<=[A-Za-z0-9_])(\[\(|\(\[|\(\(|\[|\(|\{)[^\[\](){}]+(\)\]|\]\)|\)\)|\]|\)|\})", "")
    link = r"^([A-Za-z0-9_]+)\s*-->\s*(?:\|([^|]*)\|)?\s*([A-Za-z0-9_]+)"
    part = lambda k: F.regexp_extract(bare, link, k)
    edges = lines.select("diagram_id", part(1).alias("src"), part(3).alias("dst"), F.nullif(part(2), F.lit("")).alias("label")).filter("src <> ''")
    ends = edges.select("diagram_id", F.col("src").alias("id")).unionByName(edges.select("diagram_id", F.col("dst").alias("id")))
    loose = ends.select("diagram_id", "id", F.col("id").alias("label"), F.lit(1 << 30).alias("at"))
    nodes = defined.unionByName(loose).groupBy("diagram_id", "id").agg(F.min_by("label", "at").alias("label"))
    return nodes, edges


#: What stands around a node's name, by the node's label; other labels have square brackets.
SHAPES = {"Concept": ("[", "]"), "MemoryCard": ("([", "])"), "Session": (">", "]"), "ChatSession": (">", "]"), "Diagram": ("{", "}"), "MindFileEntry": ("((", "))")}


def diagram_text(nodes: DataFrame, edges: DataFrame, layout: str = "TD") -> DataFrame:
    """nodes(graph, node, name, label), edges(graph, src, dst, type) -> graph, code: one diagram a graph, of a size a reader can take in.

    Nodes are numbered in order of ``node``; names of over 40 characters end in dots after 37. Edges whose ends are not among the graph's nodes go. Without a name, a node shows its own id.
    """
    ids = nodes.withColumn("k", F.row_number().over(Window.partitionBy("graph").orderBy("node")))
    name = F.translate(F.replace(F.coalesce("name", F.col("node").cast("string")), F.lit('"'), F.lit("'")), "[]", "()")
    name = F.when(F.length(name) > 40, F.concat(F.substring(name, 1, 37), F.lit("..."))).otherwise(name)
    around = lambda side: F.coalesce(F.create_map(*[F.lit(x) for label, ends in SHAPES.items() for x in (label, ends[side])])[F.coalesce("label", F.lit(""))], F.lit("[]"[side]))
    box = F.concat(F.lit("    N"), "k", around(0), name, around(1))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    boxes = ids.groupBy("graph").agg(joined(F.struct("k", box.alias("t"))).alias("boxes"))
    a, b = ids.select("graph", F.col("node").alias("src"), F.col("k").alias("a")), ids.select("graph", F.col("node").alias("dst"), F.col("k").alias("b"))
    line = F.format_string("    N%d -->|%s| N%d", "a", F.lower(F.replace("type", F.lit("_"), F.lit(" "))), "b")
    links = edges.join(a, ["graph", "src"]).join(b, ["graph", "dst"]).groupBy("graph").agg(joined(F.struct("a", "b", line.alias("t"))).alias("links"))
    return boxes.join(links, "graph", "left").select("graph", F.concat_ws("\n", F.lit(f"flowchart {layout}"), "boxes", "links").alias("code"))


def concept_document(concepts: DataFrame, is_a: DataFrame, others: DataFrame, maps: DataFrame, most: int = 50) -> DataFrame:
    """One row a concept, for all concepts at once: node and its own columns, parents, children, relationships and codes.

    concepts(node, term, tag and others), is_a(child, parent), others(src, type, dst, grp), maps(node, code, grp, priority, advice). Parents, the first ``most``
    children and relationships carry the other end's term; ends that are no concepts go, repeated edges are one. Codes are in order of
    group and priority. A concept without any has empty lists. Only children may be very many, and those are cut to ``most`` before they are shuffled.
    """
    ends = concepts.select(F.col("node").alias("end"), "term", "tag")
    up = is_a.select("child", "parent").distinct()
    place = F.row_number().over(Window.partitionBy("parent").orderBy("child"))
    known = up.join(ends.select(F.col("end").alias("child")), "child", "left_semi")
    down = known.withColumn("_r", place).filter(F.col("_r") <= most).select(F.col("parent").alias("node"), F.col("child").alias("end"))
    listed = lambda rows, name, *fields: rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    parents = listed(up.select(F.col("child").alias("node"), F.col("parent").alias("end")).join(ends, "end"), "parents", "end", "term", "tag")
    children = listed(down.join(ends, "end"), "children", "end", "term", "tag")
    beside = others.select(F.col("src").alias("node"), "type", F.col("dst").alias("end"), "grp").distinct().join(ends, "end")
    out = concepts.join(parents, "node", "left").join(children, "node", "left").join(listed(beside, "relationships", "type", "end", "grp", "term"), "node", "left")
    out = out.join(listed(maps.select("node", "grp", "priority", "code", "advice").distinct(), "codes", "grp", "priority", "code", "advice"), "node", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({c: empty(c) for c in ("parents", "children", "relationships", "codes")})


def drug_document(drugs: DataFrame, links: DataFrame, crosswalk: DataFrame, concepts: DataFrame, most: int = 50) -> DataFrame:
    """One row a drug, for all drugs at once: node and its own columns, its first ``most`` relationships by type and end, and the concepts it stands for.

    drugs(node, term, kind and others), links(src, type, dst), crosswalk(node, concept), concepts(node, term, tag). Ends that are no drugs, or no concepts, go; repeated rows are one.
    """
    ends = drugs.select(F.col("node").alias("end"), F.col("term").alias("end_term"), F.col("kind").alias("end_kind"))
    known = links.select(F.col("src").alias("node"), "type", F.col("dst").alias("end")).distinct().join(ends, "end")
    first = known.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("type", "end"))).filter(F.col("_r") <= most)
    beside = first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("type", "end", F.col("end_term").alias("term"), F.col("end_kind").alias("kind")))).alias("relationships"))
    refs = crosswalk.select("node", "concept").distinct().join(concepts.select(F.col("node").alias("concept"), F.col("term").alias("_t"), F.col("tag").alias("_g")), "concept")
    crossrefs = refs.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("concept", F.col("_t").alias("term"), F.col("_g").alias("tag")))).alias("crossrefs"))
    out = drugs.join(beside, "node", "left").join(crossrefs, "node", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("relationships", "crossrefs")})


def scoped(edges: DataFrame, anchors: DataFrame, steps: int, types: list[str] | None = None, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The nearest n nodes of each anchor over edges (src, dst, type) of some types, with their distance and place; and the edges between them."""
    own = edges if types is None else edges.filter(F.col("type").isin(types))
    near = neighborhood(own, anchors, steps)
    place = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))
    nodes = written(near.withColumn("place", place).filter(F.col("place") <= n), "nearest")
    members = nodes.select("seed", "node").unionByName(anchors.select(F.col("node").alias("seed"), "node"))
    src, dst = (members.withColumnRenamed("node", c) for c in ("src", "dst"))
    return nodes, own.join(src, "src").join(dst, ["seed", "dst"]).select("seed", "src", "dst", "type").distinct()


def artifact_lineage(edges: DataFrame, anchors: DataFrame, nodes: DataFrame, labels: list[str], steps: int = 3, n: int = 50) -> DataFrame:
    """The nearest n nodes of each anchor within ``steps`` (1..3) that carry one of the labels; nodes: node, label.

    Of a node's labelled neighbours only the first n + 1 are looked at: what comes before another one there is as near to the anchor, or nearer, so later
    ones are not among its n, even if the anchor is one of them. An anchor that has n is done; only the others go on, and of those no neighbour was left out.
    """
    depth, found_all = max(1, min(steps, 3)), None
    wanted = written(nodes.filter(F.col("label").isin(labels)).select("node", "label").distinct(), "wanted")
    step = _Steps(edges, HUB)
    first = step.rows.join(wanted.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("_r") <= n + 1)
    first = written(first.select("src", "dst"), "first")
    seen = front = _seed_groups(anchors)
    known = front.select("seed", "node")
    for k in range(1, depth + 1):
        near = front.select("seed", F.col("node").alias("src")).join(first, "src").select("seed", F.col("dst").alias("node")).distinct()
        near = near.join(known, ["seed", "node"], "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).filter(F.col("_r") <= n)
        near = written(near.select("seed", "node", F.lit(k).alias("distance")), "near")
        found_all = near if found_all is None else found_all.unionByName(near)
        known = known.unionByName(near.select("seed", "node"))
        if k < depth:
            done = written(found_all.groupBy("seed").agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select("seed"), "done")
            front = written(_onward(front.join(done, "seed", "left_anti"), seen.join(done, "seed", "left_anti"), step), "frontier")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
    place = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))
    return found_all.join(wanted, "node").withColumn("place", place).filter(F.col("place") <= n)


def node_search(nodes: DataFrame, edges: DataFrame, search: str, fields: list[str], key: str = "node", n: int = 20) -> DataFrame:
    """The first n nodes of which a field holds the text in any case, each with the nodes one step away in either direction (null: none)."""
    held = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(search.lower())), F.lit(False))
    hit = held(fields[0])
    for c in fields[1:]:
        hit = hit | held(c)
    found = nodes.filter(hit).select(key).orderBy(key).limit(n)
    back = edges.select(F.col("dst").alias(key), F.col("src").alias("neighbor"))
    steps = edges.select(F.col("src").alias(key), F.col("dst").alias("neighbor")).unionByName(back).distinct()
    return found.join(steps, key, "left")
