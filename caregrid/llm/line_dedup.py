"""Repeated runs of lines, by a suffix array over line ids built with prefix doubling.

A line's id is its place in the order of all repeated lines; a suffix is the
lines of a document from some line on. Prefix doubling ranks suffixes by their
first 1, 2, 4, ... lines: the rank by twice as many lines comes from the ranks
of both halves, and suffixes whose prefix nothing else shares drop out. Ranks
keep the order of the suffix array, so suffixes that share their first m lines
are one of its intervals with a longest common prefix of m or more, and two
ranks name it: that of the first 2**k lines and that of the last 2**k of the m.

What is deleted: every line of a later copy of a maximal repeated run with at
least ``min_words`` words, the first copy (by id, then line) being kept. A run
with so many words is the union of its shortest prefixes and suffixes that
reach ``min_words`` at each of its lines, and each of those is a later copy where
the run is. So an interval is looked up at that length only, for windows that
start or end at each line, and doubling stops at the longest window needed.

Ranks are sums over counts (two steps of prefix sums), never a sort of all rows,
nor of all that follows one line, in one task. Joins are equi-joins with one row
a group on one side; groups with more than 1 / HOT of the rows, of which
there are fewer than HOT, are joined by broadcast, so that no key is hot elsewhere.

Null texts stay null and count as empty. Lines are compared exactly. Rows that
agree in id and text are one document: they get equal results, and are not
copies of each other. A null id comes before all others. All columns are kept, whatever
their names (the column of removed lines takes the place of one with its name);
a text may become empty, but no row is dropped. Texts are taken whole at any
length. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, written

MIN_WORDS = 50
HOT = 4096


def windows(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, length) of the shortest windows that start, or end, at each line and have ``least`` words."""
    upto = np.concatenate([[0], np.cumsum(words)])
    lines = np.arange(len(words))
    ends = np.searchsorted(upto, upto[:-1] + least)  # first prefix that reaches it
    left = lines[ends <= len(words)]
    starts = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    right = lines[upto[1:] >= least]
    return sorted({*zip(left.tolist(), (ends[left] - left).tolist()), *zip(starts[right].tolist(), (right + 1 - starts[right]).tolist())})


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the row as it is stays in one column, so that no name of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    return rows.withColumns({"_k1": F.xxhash64("_id", "_text"), "_k2": F.xxhash64(F.lit(1), "_text", "_id")})


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """_id, _k1, _k2 (the document), pos, h1, h2 (the line), ms (lengths of the windows that start there)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, text in enumerate(batch.column(3).to_pylist()):
                lines = text.split("\n")
                hashes = [xxhash.xxh3_128_intdigest(x.encode("utf-8", "replace")) for x in lines]
                ms: list[list[int]] = [[] for _ in lines]
                for start, m in windows(np.array([len(WORD_RE.findall(x)) for x in lines]), min_words):
                    ms[start].append(m)
                out[0] += [i] * len(lines)
                out[1] += range(len(lines))
                out[2] += [h >> 64 for h in hashes]
                out[3] += [h & (1 << 64) - 1 for h in hashes]
                out[4] += ms
            at = pa.array(out[0], pa.int64())
            halves = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out[2:4]]
            yield pa.record_batch(
                [*(batch.column(c).take(at) for c in range(3)), pa.array(out[1], pa.int32()), *halves, pa.array(out[4], pa.list_(pa.int32()))], ["_id", "_k1", "_k2", "pos", "h1", "h2", "ms"]
            )

    return rows.select("_id", "_k1", "_k2", "_text").mapInArrow(run, "_id long, _k1 long, _k2 long, pos int, h1 long, h2 long, ms array<int>")


def _line_ranks(lines: DataFrame) -> DataFrame:
    """The positions of repeated lines, with the rank of the line among all of these."""
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = written(repeated.withColumn("part", F.shiftright("h1", 52)), "ids")  # 4096 parts, in order
    parts = repeated.groupBy("part").agg(F.sum("n").alias("n")).select("part", _before(Window.orderBy("part")).alias("base"))
    ranked = repeated.withColumn("in", _before(Window.partitionBy("part").orderBy("h1", "h2"))).join(parts, "part")
    named = ranked.select("h1", "h2", "n", (F.col("base") + F.col("in")).alias("r"))
    return _joined(lines, named, ["h1", "h2"]).select("_id", "_k1", "_k2", "pos", "ms", "r")


def _before(window: Window) -> Column:
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (a written table or little work) with the columns of their group; ``groups`` has one row a key, with its number of rows n."""
    groups = written(groups, "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > F.lit(total)  # fewer than HOT groups can have so many rows
    hot = groups.filter(is_hot)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    names = [c for c in groups.columns if c not in keys]
    cold = marked.filter("_hot IS NULL").select(*rows.columns).join(groups.filter(~is_hot), keys)
    return cold.select(*rows.columns, *names).unionByName(marked.filter("_hot").select(*rows.columns, *names))


def _doubled(level: DataFrame, span: int) -> DataFrame:
    """Ranks by 2 * span lines of the suffixes whose first 2 * span lines occur again."""
    doc = Window.partitionBy("_k1", "_k2").orderBy("pos").rangeBetween(span, span)  # the one line at that distance
    paired = written(level.withColumn("r2", F.max("r").over(doc)).filter("r2 IS NOT NULL"), "paired")
    pairs = paired.groupBy("r", "r2").agg(F.count("*").alias("n")).filter("n > 1").withColumn("part", F.shiftright("r2", 12))
    pairs = written(pairs, "pairs")
    # what follows a very common line is ranked in parts of at most 4096 ranks
    parts = pairs.groupBy("r", "part").agg(F.sum("n").alias("n")).select("r", "part", _before(Window.partitionBy("r").orderBy("part")).alias("base"))
    inside = pairs.withColumn("in", _before(Window.partitionBy("r", "part").orderBy("r2")))
    named = inside.join(parts, ["r", "part"]).select("r", "r2", "n", (F.col("r") + F.col("base") + F.col("in")).alias("rank"))
    return _joined(paired, named, ["r", "r2"]).select("_id", "_k1", "_k2", "pos", "ms", F.col("rank").alias("r"))


def _later(level: DataFrame, span: int) -> DataFrame:
    """(_k1, _k2, pos, m): windows of span to 2 * span - 1 lines that have an earlier copy."""
    own = level.select("_id", "_k1", "_k2", "pos", "r", F.explode("ms").alias("m")).filter((F.col("m") >= span) & (F.col("m") < 2 * span))
    if span == 1:
        found = own.withColumn("r2", F.col("r"))
    else:
        tail = level.select("_k1", "_k2", F.col("pos").alias("_at"), F.col("r").alias("r2"))
        found = written(own.withColumn("_at", F.col("pos") + F.col("m") - span).join(tail, ["_k1", "_k2", "_at"]).drop("_at"), "windows")
    place = F.struct("_id", "_k1", "_k2", "pos")
    interval = found.groupBy("m", "r", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return _joined(found, interval, ["m", "r", "r2"]).filter(place != F.col("first")).select("_k1", "_k2", "pos", "m")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_k1, _k2, cuts): for each document that has any, its windows (pos, m) to delete."""
    lines = written(_lines(_keyed(docs, id_col, text_col), min_words), "lines")
    once = lines.dropDuplicates(["_k1", "_k2", "pos"])
    level, span, later = written(_line_ranks(once), "rank"), 1, []
    while True:
        later.append(written(_later(level, span), "later"))
        longest = level.agg(F.max(F.array_max("ms"))).first()[0]
        if longest is None or longest < 2 * span:
            break
        level = written(_doubled(level, span), "rank")
        span *= 2
    cuts = later[0]
    for x in later[1:]:
        cuts = cuts.unionByName(x)
    # a document's windows are at most two a line
    return cuts.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("pos", "m")).alias("cuts"))


def _without(text: pd.Series, cuts: pd.Series) -> pd.DataFrame:
    new, lost = [], []
    for t, windows_ in zip(text, cuts):
        gone = 0
        if t is not None:
            lines = t.split("\n")
            keep = np.ones(len(lines), bool)
            for w in windows_:
                keep[w["pos"] : w["pos"] + w["m"]] = False
            t, gone = "\n".join([x for x, k in zip(lines, keep) if k]), int((~keep).sum())
        new.append(t)
        lost.append(gone)
    return pd.DataFrame({"text": pd.Series(new, dtype=object), "lost": pd.Series(lost, dtype="int64")})


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, removed_col: str | None = None) -> DataFrame:
    """``docs`` with later copies deleted from the text, and, if it gets a name, how many lines went."""
    cuts = repeated_runs(docs, id_col, text_col, min_words)
    rows = _keyed(docs, id_col, text_col).join(cuts, ["_k1", "_k2"], "left")
    hit = F.col("cuts").isNotNull()
    new = F.pandas_udf(_without, "text string, lost long")(F.when(hit, F.col("_text")), F.col("cuts"))
    rows = rows.select("_row", hit.alias("_hit"), new.alias("_new"))
    text = F.when(F.col("_hit"), F.col("_new.text")).otherwise(F.col(f"_row.`{text_col}`"))
    names = [text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != removed_col]
    if removed_col:
        names.append(F.col("_new.lost").alias(removed_col))
    return rows.select(*names)
