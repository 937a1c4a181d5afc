"""Shards of near equal bytes by k-d tree partitioning of document metadata.

The tree splits its widest metadata dimension at a weighted median until every
leaf holds one shard's share of the bytes. Dimensions, each scaled to 0..1:
logarithm of the size, source, language and id (names through a hash, so no
dictionary is gathered). A node for k shards sends ceil(k/2)/k of its bytes to
its lower side.

Medians are found by bisection of the key range, not by sorting: a pass sums
bytes a node and key range, a bounded table whatever the input, and the range that
holds the median is cut finer in the next pass. The last bits of a key come
from a hash of the row, so a value that a third of all rows share is split
inside. Everything is DataFrame expressions; only split points (a row a node)
come to the driver.

Null texts have no bytes, null metadata and null ids sort as 0; a row's size is
its UTF-8 bytes plus 8. Rows that agree in id, metadata and text may go to
different shards, as all ties may. Texts of any length are measured whole; a
row is never split, so a shard may exceed its share by one row. Columns other
than the id, the text and ``dims`` do not matter. Slots are gapless from 0 in each
shard. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 10  # of a key, resolved in one pass
ROUNDS = 4
SLOT_ROWS = 20_000


def kd_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """One row a document: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: the law is not 'key')."""
    rows = written(_metadata(docs, id_col, text_col, dims), "kd")
    names = [c for c in rows.columns if c.startswith("_d")]
    shard = _tree(rows, names, shards).cast("int")
    return _slots(rows.withColumn("shard", shard)).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _metadata(docs: DataFrame, id_col: str, text_col: str, dims: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    have = [d for d in dims if d in docs.columns]
    top = float(1 << (BITS * ROUNDS - 20))
    base = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[F.col(d).cast("string").alias(f"_m{k}") for k, d in enumerate(have)],
    )
    # a row's number goes in, so that rows alike in all columns can be split; the table is written once, with it
    low = F.pmod(F.xxhash64("_id", "size", "text_crc32", F.monotonically_increasing_id()), F.lit(1 << 20))
    unit = [F.least(F.log2(F.col("size")) / 40, F.lit(1.0))]
    unit += [F.when(F.col(f"_m{k}").isNull(), 0.0).otherwise(F.pmod(F.xxhash64(f"_m{k}"), F.lit(1 << 20)) / float(1 << 20)) for k in range(len(have))]
    # ids by their leading digits: order is kept, and no maximum is needed
    unit.append(F.when(F.coalesce(F.col("_id"), F.lit(0)) <= 0, 0.0).otherwise(F.log2(F.col("_id") + 1.0) / 64))
    keys = [(F.floor(u * (top - 1)).cast("long") * (1 << 20) + low).alias(f"_d{k}") for k, u in enumerate(unit)]
    return base.select("_id", "size", "text_crc32", *keys)


def _tree(rows: DataFrame, names: list[str], shards: int) -> Column:
    """The shard of a row, as nested conditions on its keys: one for each split."""
    splits: dict[int, tuple[str, int, int]] = {}  # first shard of a node and its number of shards -> dimension, split point

    def place(first: int, n: int) -> Column:
        if (first, n) not in splits:
            return F.lit(first)
        dim, point = splits[first, n]
        return F.when(F.col(dim) < F.lit(point), place(first, (n + 1) // 2)).otherwise(place(first + (n + 1) // 2, n // 2))

    open_ = [(0, shards)] if shards > 1 else []
    while open_:
        at = rows.withColumn("_node", place(0, shards)).filter(F.col("_node").isin([f for f, _ in open_]))
        ends = [f(c).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]
        nodes = []
        for r in at.groupBy("_node").agg(F.sum("size").alias("size"), *ends).collect():  # a row a node
            n = dict(open_)[r["_node"]]
            dim = max(range(len(names)), key=lambda k: r[f"hi{names[k]}"] - r[f"lo{names[k]}"])
            nodes.append([r["_node"], dim, r["size"] * ((n + 1) // 2) / n, 0, 0])
        if not nodes:  # no rows
            break
        for shift in range(BITS * (ROUNDS - 1), -1, -BITS):  # each pass fixes BITS more bits of the split points
            nodes = _finer(at, names, nodes, shift)
        for node, dim, _, point, _ in nodes:
            splits[node, dict(open_)[node]] = (names[dim], point)
        halves = [h for f, n in open_ if (f, n) in splits for h in ((f, (n + 1) // 2), (f + (n + 1) // 2, n // 2))]
        open_ = [h for h in halves if h[1] > 1]
    return place(0, shards)


def _finer(at: DataFrame, names: list[str], nodes: list[list], shift: int) -> list[list]:
    """Of each node's key range, the part in which the wanted share of the bytes is reached; in the end, the key nearest to it."""
    values = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("_node", "dim", "want", "start", "below"), [n, d, float(w), s, float(b)])]) for n, d, w, s, b in nodes]
    table = at.sparkSession.range(1).select(F.inline(F.array(*values)))
    key = F.element_at(F.array(*names), F.col("dim") + 1)
    inside = at.join(F.broadcast(table), "_node").withColumn("key", key).filter(F.shiftright("key", shift + BITS) == F.col("start"))
    sums = inside.groupBy("_node", "dim", "want", "below", F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("_node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    reached = sums.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0))).filter(F.col("below") <= F.col("want"))
    cut = reached.groupBy("_node", "dim", "want").agg(F.max(F.struct("part", "below", "size")).alias("at")).select("_node", "dim", "want", "at.*")
    rows = cut.collect()  # a row a node
    over = lambda r: shift == 0 and 2 * (r["want"] - r["below"]) > r["size"]
    return [[r["_node"], r["dim"], r["want"], r["part"] + over(r), r["below"]] for r in rows]


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard in runs of bounded size, so that no task has a whole shard."""
    runs = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_id", "text_crc32", F.monotonically_increasing_id()), F.lit(runs)))
    counts = rows.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "_run", F.coalesce(before, F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_id", "text_crc32"))
    return rows.withColumn("_k", number).join(starts, ["shard", "_run"]).withColumn("slot", F.col("_start") + F.col("_k") - 1)
