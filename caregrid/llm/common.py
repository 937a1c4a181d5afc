"""What the corpus operators share: table access, column set-up, cut lineage, word scans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

#: Spark's setting by which a query's shuffle files go when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` (long) and ``_text`` (null: empty); further columns, whatever their names, are left out."""
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (all columns, so that no name of it can clash), ``_id``, ``_text`` and ``_k1``, ``_k2``: equal where id and text are, null ids too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    return rows.withColumns({"_k1": F.xxhash64("_id", "_text"), "_k2": F.xxhash64(F.lit(1), "_text", "_id")})


def one_each(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``keyed_rows`` that have the smallest (id, text hash) of their component: exactly one of each.

    ``found`` has one row a row: _id, _k1, _k2 and root, the component. A null id is greater than all others.
    Rows that are alone in their component, but for some by chance, stay where they are: a bit map of fixed size tells which.
    """
    alike = written(found.groupBy("root", "_id", "_k1", "_k2").agg(F.count("*").alias("_n")), "alike")
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_k1"), F.col("_k2"), F.col("_n")))
    least = written(alike.groupBy("root").agg(first.alias("_m"), F.sum("_n").alias("_rows")), "least")
    held_roots = holds(least.filter("_rows > 1").select("root"))
    held = holds(alike.filter(held_roots("root")).select("_k1"))
    kept = rows.select("_row", "_k1", "_k2").filter(held("_k1")).join(least.select("_m._k1", "_m._k2", "_m._n"), ["_k1", "_k2"])
    again = kept.filter("_n > 1").dropDuplicates(["_k1", "_k2"])  # rows equal in id and text: any one of them
    alone = rows.select("_row", "_k1").filter(~held("_k1"))
    return alone.select("_row.*").unionByName(kept.filter("_n = 1").select("_row.*")).unionByName(again.select("_row.*"))


def holds(hashes: DataFrame) -> Callable[[str], Column]:
    """Whether a long column is among ``hashes``, true for some others by chance."""
    map_ = hashes.sparkSession.sparkContext.broadcast(bit_map(hashes))

    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        return pd.Series(in_map(map_.value, column.to_numpy()))

    return holds


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a folder of our own in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/caregrid/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors cost nothing.

    Spark drops the shuffle files of the write as soon as it has ended; nothing reads them again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bit_map(hashes: DataFrame, bits: int = 26) -> np.ndarray:
    """A map of 2 ** bits bits (as longs) with those set that the first bits of ``hashes``, one long column, name. The driver gets that much at most."""
    h = F.col(hashes.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 64 - bits).bitwiseAND(63).cast("int"))
    held = hashes.groupBy(F.shiftrightunsigned(h, 70 - bits).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << bits >> 6, np.int64)
    out[held.column("at").to_numpy()] = held.column("bits").to_numpy()
    return out


def in_map(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which longs the map has, with some that it has by chance."""
    at = hashes.view(np.uint64) >> np.uint64(64 - 6 - (len(table).bit_length() - 1))
    return table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64) & 1 > 0


def by_bytes(texts: list[str], most: int = 1 << 20):
    """(start, end) of runs of texts with about ``most`` characters each; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
