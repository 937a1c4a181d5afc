"""Near duplicates by SimHash: pigeonhole blocks, join on blocks, Hamming check.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in at
most three bits agree in at least three blocks, so each one is filed under its
20 choices of three blocks, and only fingerprints filed together are compared.
Work is done on different fingerprints, so exact copies cost one. Where a file
has grown beyond HOT fingerprints its members are filed again by three of six
blocks of their remaining bits; such a file holds at most 2**16 of them, whatever
the input. No pair is skipped, and files give a spanning set of links
instead of all pairs. Linked fingerprints are joined into components.

Null and empty texts, and texts without words, have fingerprint zero and are
linked like any other. Null ids take part; a component's id is its smallest
id that is not null. Repeated rows are repeated in the result, extra columns are
left out, texts are taken whole at any length, and an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .components import components

HOT = 1024


def fingerprint(text: str, width: int = 3) -> int:
    """Unsigned; bit k is 1 if it is set in over half of the hashes of the text's shingles."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(size) - size
    ends = (starts + size - 1)[width - 1 :].tolist() if len(words) >= width else [len(flat)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(flat[a:b], 42) for a, b in zip(starts[:n].tolist(), ends)], ">u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id and fp (the 64 bits as a signed long)."""
    return _with_fp(id_and_text(docs, id_col, text_col), width).withColumnRenamed("_id", id_col)


def _with_fp(rows: DataFrame, width: int) -> DataFrame:
    """fp in the place of _text, the last column; the others are longs and stay."""
    names = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(len(names)).to_pylist()], np.uint64)
            yield pa.record_batch([*(batch.column(k) for k in range(len(names))), pa.array(fps.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: list[int]) -> list[int]:
    """The bits of each choice of three of six blocks of these bits."""
    cuts = [round(k * len(bits) / 6) for k in range(7)]
    blocks = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _filed(fps: DataFrame, masks: Column, *keep: str) -> DataFrame:
    return fps.select("fp", *keep, F.posexplode(masks).alias("_k", "_mask")).select("fp", *keep, "_k", F.expr("fp & _mask").alias("_key"))


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): fingerprints at 1 to ``most`` (at most 3) differing bits; enough of them to join all that are so linked."""
    first = _masks(list(range(64)))
    again = [[m | x for x in _masks([b for b in range(64) if not m >> b & 1])] for m in first]
    array = lambda xs: F.array(*[F.lit(_signed(x)) for x in xs])
    filed = _filed(fps.select("fp").distinct(), array(first))
    # partial counts first: a file that a third of all fingerprints share sends a row a task
    sizes = filed.groupBy("_k", "_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = written(filed.join(sizes, ["_k", "_key"]), "filed")
    nested = F.element_at(F.array(*[array(x) for x in again]), F.col("_k0") + 1)
    hot = shared.filter(F.col("_n") > HOT).select("fp", F.col("_k").alias("_k0"))
    hot = hot.select("fp", F.posexplode(nested).alias("_k1", "_mask"), "_k0").select(
        "fp", (F.col("_k0") * 32 + F.col("_k1") + 32).alias("_k"), F.expr("fp & _mask").alias("_key")
    )
    together = shared.filter(F.col("_n") <= HOT).select("_k", "_key", "fp").unionByName(hot.select("_k", "_key", "fp"))

    def run(batches):
        held = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]).astype(np.int64)
            held = rows if held is None else np.concatenate([held, rows], axis=1)
            if not held.shape[1]:
                continue
            last = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))
            cut = last[-1] + 1 if len(last) else 0  # the last file may go on in the next batch
            if cut:
                yield _edges(held[:, :cut], most)
                held = held[:, cut:]
        if held is not None and held.shape[1]:
            yield _edges(held, most)

    dealt = together.repartition(F.col("_k"), F.col("_key")).sortWithinPartitions("_k", "_key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= most


def _edges(rows: np.ndarray, most: int) -> pa.RecordBatch:
    """Links within files that lie one after the other: all pairs of small files, a spanning forest of others."""
    fp = rows[2]
    start = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
    size = np.diff(np.append(start, len(fp)))
    left = np.repeat(start + size, size) - np.arange(len(fp))  # members from here on
    small = np.repeat(size <= 8, size)
    a, b = [], []
    for lag in range(1, 8):
        at = np.flatnonzero(small & (left > lag))
        at = at[_near(fp[at], fp[at + lag], most)]
        a.append(fp[at])
        b.append(fp[at + lag])
    for s, n in zip(start[size > 8].tolist(), size[size > 8].tolist()):
        x, y = _forest(fp[s : s + n], most)
        a.append(x)
        b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    keep = a != b
    return pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth first: each member found is tied to the one that found it."""
    fp = np.unique(fp)
    free = np.ones(len(fp), bool)
    a, b = [], []
    for root in range(len(fp)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(free)
            found = rest[_near(fp[rest], fp[at], most)]
            if len(found):
                free[found] = False
                a.append(np.full(len(found), fp[at]))
                b.append(fp[found])
                queue += found.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _rooted(distinct: DataFrame, most: int) -> DataFrame:
    """``distinct`` (one row a fingerprint) with root, the smallest fingerprint of its component."""
    roots = components(links(distinct, most))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id (smallest id of all that are linked)."""
    held = written(fingerprints(docs, id_col, text_col, width).select(F.col(id_col).alias("_id"), "fp"), "fingerprints")
    named = _rooted(held.groupBy("fp").agg(F.min("_id").alias("_least")), most)
    # a component may hold very many fingerprints: partial minima first, then one row a root
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return held.join(classes, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
