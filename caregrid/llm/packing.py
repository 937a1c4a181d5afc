"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

``token_pieces`` cuts each document's ids (and an end id) into pieces of at
most the capacity; only longer documents are cut. ``pack`` places pieces:
a bin is filled greedily, largest piece first; then its smallest piece gives
way to the two unpacked pieces that fit the widened gap most tightly, if they
fill it better. Pieces are dealt evenly into groups of bounded size, each
packed in its own task; the pieces of bins that stay too empty are dealt anew
into fewer groups and packed once more, so hardly any bin is left half filled.
No piece is dropped, and no group grows with the input; a task packs one group
after the other, so the number of tasks is bounded too.

Null texts are empty documents (a piece with the end id alone). A text of any
length is taken whole and cut only at the capacity. Repeated rows are packed as
often as they occur, and equal lengths are packed in any order. Further columns
of the pieces go along whatever their names, but for sequence_id and offset,
which the result replaces. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import by_bytes, id_and_text, written
from .words import TokenizerIds, worker_ids

GROUP = 4096
MOST_TASKS = 8192


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""

    def run(batches):
        tok = worker_ids(TokenizerIds, vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = batch.column(0)
            for a, b in by_bytes(texts):
                rows = []
                for k, ids in enumerate(tok.ids(texts[a:b]), a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(k, p, s, ids[s : s + capacity]) for p, s in enumerate(range(0, len(ids), capacity))]
                cols = [
                    keys.take(pa.array([r[0] for r in rows])),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([len(r[3]) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r[3].tobytes()) for r in rows], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.record_batch(cols, names)

    names = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def best_two_fit(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin, its place there, and how full that bin is."""
    lengths = np.asarray(lengths, np.int64)
    stacks: dict[int, list[int]] = {}
    for k in np.argsort(-lengths, kind="stable").tolist():
        stacks.setdefault(int(lengths[k]), []).append(k)
    free = sum(1 << n for n in stacks)  # bit n: a piece of n tokens is unpacked
    where, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))

    def largest(most: int) -> int:
        return (free & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal free
        k = stacks[n].pop()
        if not stacks[n]:
            free ^= 1 << n
        return k

    bin_no = 0
    while free:
        held, gap = [], capacity
        while gap > 0 and (n := largest(gap)) > 0:
            held.append(take(n))
            gap -= n
        if gap > 0 and held and free:
            small = int(lengths[held[-1]])  # filled largest first
            pair, best = None, small
            a = largest(small + gap - 1)
            while a > 0 and 2 * a > best:
                b = largest(min(a, small + gap - a))
                if b == a and len(stacks[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    pair, best = (a, b), a + b
                    if best == small + gap:
                        break
                a = largest(a - 1)
            if pair:
                back = held.pop()
                held += [take(pair[0]), take(pair[1])]
                stacks[small].append(back)
                free |= 1 << small
        at = 0
        for k in held:
            where[k], offset[k] = bin_no, at
            at += int(lengths[k])
        fill[held] = at
        bin_no += 1
    return where, offset, fill


def pack(pieces: DataFrame, capacity: int = 4096, group: int = GROUP, full: float = 0.98) -> DataFrame:
    """The pieces, with sequence_id and offset. Needs a column ``length`` from 1 to the capacity; other columns go along."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # the row goes along as one column, so that no name of it can clash
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    held = written(pieces.select(row, F.col("length").cast("long").alias("n")), "pieces")
    first = written(_packed(held, capacity, group), "packed")
    loose = F.col("fill") < F.lit(int(full * capacity))
    last = _packed(first.filter(loose).select("row", "n"), capacity, group)
    tag = lambda df, k: df.select(*[F.col(f"row.`{c}`").alias(c) for c in names], (F.col("seq") * 2 + k).alias("sequence_id"), F.col("at").alias("offset"))
    return tag(first.filter(~loose), 0).unionByName(tag(last, 1))


def _packed(pieces: DataFrame, capacity: int, group: int) -> DataFrame:
    """row, n, seq, at, fill."""
    groups = max(1, -(-pieces.count() // group))
    # the rows come from a written table, so their numbers are the same when a task runs again
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        where, offset, fill = best_two_fit(rows.column("n").to_numpy(), capacity)
        number = rows.column("part").to_numpy() * (1 << 24) + where
        return pa.table({"row": rows.column("row"), "n": rows.column("n"), "seq": pa.array(number), "at": pa.array(offset), "fill": pa.array(fill)})

    schema = StructType([StructField("row", pieces.schema["row"].dataType), *(StructField(c, LongType()) for c in ("n", "seq", "at", "fill"))])
    return dealt.repartition(min(groups, MOST_TASKS), "part").groupBy("part").applyInArrow(run, schema)
