"""Similarity join by n-gram Jaccard, exact: rarest tokens, signature trees, full comparison.

A document's set holds the different ``width``-word shingles of its whole text. Two sets link when
100 * intersection >= percent * union. Of a set of n shingles, n - ceil(percent * n / 100) + 1
can never all be missing from a set it links with, in whatever order shingles are taken, as long as all sets
use the same one. So a set is filed under so many of its first shingles, shingles that
few sets have come first, and linked sets share a file; ``signature_tree`` searches the files.
The order is by a table of SLOTS counts of all sets' shingles, then by hash; the table has a fixed size and
decides only how long files get. Equal sets are one.

Shingles are 64-bit hashes of word sequences. Pairs that the trees leave are compared by their full sets,
which are made again from the texts: each task picks the texts it needs by a bit map of fixed size, and a
join drops what the map let through by chance.

Null and empty texts, and texts without words, have the empty set and are linked with nothing; fewer
words than ``width`` make one shingle. Null ids take part; a component's id is its smallest id that is not null (null
if it has none). Repeated rows are repeated in the result, extra columns are left out, whatever their names, texts are taken whole
at any length, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, by_bytes, holds, in_map, keyed_rows, written
from .components import components
from .signature_tree import shared, signature, tree_links

WIDTH = 5
PERCENT = 80
SLOTS = 18


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The different hashes of the text's shingles, in order."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(x ^ (x >> np.uint64(32)))


def _texts(batch: pa.RecordBatch, column: int):
    texts = batch.column(column).to_pylist()
    for a, z in by_bytes(texts):
        yield a, texts[a:z]


def _counts(width: int):
    """(slot, n) of one task's shingles."""

    def run(batches):
        held = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for _, texts in _texts(batch, 0):
                slots = np.concatenate([shingles(t, width) for t in texts]) >> np.uint64(64 - SLOTS)
                held += np.bincount(slots.astype(np.int64), minlength=1 << SLOTS)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(held[at])], ["slot", "n"])

    return run


def ranked(rows: DataFrame, width: int) -> Broadcast:
    """A rank for each slot of hashes by its number of shingles in all sets of ``rows`` (_text), for ``firsts``."""
    counts = written(rows.select("_text").mapInArrow(_counts(width), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")), "counts").toArrow()
    rank = np.zeros(1 << SLOTS, np.uint8)
    rank[counts.column("slot").to_numpy()] = np.log2(counts.column("n").to_numpy().astype(float) + 1).astype(np.uint8)
    return rows.sparkSession.sparkContext.broadcast(rank)


def firsts(s: np.ndarray, percent: int, order: Broadcast) -> np.ndarray:
    """The shingles that a set is filed under, as signed longs."""
    rank = order.value[(s >> np.uint64(64 - SLOTS)).astype(np.int64)]
    return s[np.lexsort((s, rank))[: len(s) + -percent * len(s) // 100 + 1 if len(s) else 0]].view(np.int64)


def _sketches(width: int, percent: int, order: Broadcast):
    """The row's keys with node (names the set), n, over, bits and first, the shingles it is filed under."""

    def run(batches):
        for batch in batches:
            for a, texts in _texts(batch, 3):
                sets = [shingles(t, width) for t in texts]
                signs = [signature(s) for s in sets]
                first = [firsts(s, percent, order) for s in sets]
                node = pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
                columns = [node, pa.array([len(s) for s in sets], pa.int64()), pa.array([k for _, k in signs], pa.int64()), pa.array([b for b, _ in signs], pa.binary()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.record_batch([*(batch.column(c).slice(a, len(texts)) for c in range(3)), *columns], ["_id", "_k1", "_k2", "node", "n", "over", "bits", "first"])

    return run


def filed(held: DataFrame) -> DataFrame:
    """(key, node), different ones: what sets are filed under, without most keys that only one set has.

    Only rows of nodes that several rows have, and some others by chance, move. No task has two Python workers at work: those that
    a chain of Python steps leaves behind hold memory for a minute.
    """
    again = held.groupBy("node").agg(F.count("*").alias("_n")).filter("_n > 1").select("node")
    again, rows = written(again, "copied"), held.select("node", "first")
    copied, context = holds(again)("node"), held.sparkSession.sparkContext
    twice = written(rows.filter(copied).dropDuplicates(["node"]), "twice")
    keys = rows.filter(~copied).unionByName(twice).select(F.explode("first").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    alone, map_ = context.broadcast(bit_map(again)), context.broadcast(bit_map(written(keys.select("key"), "again")))

    def run(batches, skip=None):
        for batch in batches:
            if skip:
                batch = batch.filter(pa.array(~in_map(skip.value, batch.column(0).to_numpy())))
            first = batch.column(1)
            key, node = first.flatten(), batch.column(0).take(pc.list_parent_indices(first))
            hit = pa.array(in_map(map_.value, key.to_numpy()))
            yield pa.record_batch([key.filter(hit), node.filter(hit)], ["key", "node"])

    kinds = "key long, node long"
    return written(rows.mapInArrow(lambda batches: run(batches, alone), kinds).unionByName(twice.mapInArrow(run, kinds)), "filed")


def picked(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (node, _k1, _k2 and others) with hashes, made from the texts."""
    map_ = rows.sparkSession.sparkContext.broadcast(bit_map(wanted.select("_k1")))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_map(map_.value, batch.column(0).to_numpy())))
            for a, texts in _texts(batch, 2):
                hashes = pa.array([shingles(t, width).tobytes() for t in texts], pa.binary())
                yield pa.record_batch([*(batch.column(c).slice(a, len(texts)) for c in range(2)), hashes], ["_k1", "_k2", "hashes"])

    made = rows.select("_k1", "_k2", "_text").mapInArrow(run, "_k1 long, _k2 long, hashes binary")
    # rows that repeat id and text have the same keys
    return made.dropDuplicates(["_k1", "_k2"]).join(wanted, ["_k1", "_k2"]).drop("_k1", "_k2")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    rows = keyed_rows(docs, id_col, text_col).select("_id", "_k1", "_k2", "_text")
    order = ranked(rows, width)
    held = written(rows.mapInArrow(_sketches(width, percent, order), "_id long, _k1 long, _k2 long, node long, n long, over long, bits binary, first array<long>"), "sketches")
    signs = held.filter("n > 0").select("node", "n", "over", "bits")
    keys = held.groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("_m")).select("node", "_m.*")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return picked(rows, written(keys.join(nodes, "node"), "wanted"), width)

    links = tree_links(shared(filed(held)), signs, sets_of, percent)
    roots = components(links)
    # a component may hold very many sets: partial minima first, then one row a root
    named = held.groupBy("node").agg(F.min("_id").alias("_least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.select("node", "root").join(named.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("node", "component_id")
    found = held.select("_id", "node", "n").join(classes, "node")
    alone = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"))
