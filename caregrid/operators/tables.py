"""Table maintenance: upsert, insert, replace, delete, merge of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str]) -> DataFrame:
    """The next version: on a known key only ``update`` is overwritten; new keys are added whole. Keys are unique on either side."""
    fresh = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in old.columns if c != key], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(fresh, key, "full")
    take = lambda c: F.when(F.col("_old").isNull(), F.col(f"_n_{c}")).when(F.col("_new") & F.lit(c in update), F.col(f"_n_{c}")).otherwise(F.col(c))
    return both.select(*[F.col(c) if c == key else take(c).alias(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def replace_part(old: DataFrame, new: DataFrame, part: str, value) -> DataFrame:
    """One vintage exchanged for another; rows of other vintages stay."""
    return old.filter(~F.col(part).eqNullSafe(F.lit(value))).unionByName(new.filter(F.col(part) == F.lit(value)))


def delete_prefix(rows: DataFrame, key: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """What stays, and a table with the number of rows that went."""
    hit = F.coalesce(F.startswith(F.col(key), F.lit(prefix)), F.lit(False))
    return rows.filter(~hit), rows.agg(F.count_if(hit).alias("deleted"))


def split_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Counts of rows whose key is known and is not."""
    keys = known.select(key).distinct().withColumn("_known", F.lit(True))
    return rows.join(keys, key, "left").agg(F.count_if("_known").alias("loaded"), F.count_if(F.col("_known").isNull()).alias("skipped"))


def absent(rows: DataFrame, done: DataFrame, key: Column, done_key: str) -> DataFrame:
    """Rows whose derived key is not in the store yet."""
    return rows.withColumn("_key", key).join(done.select(F.col(done_key).alias("_key")), "_key", "left_anti").drop("_key")


def precedence_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both tables' rows; for a key in both, the first table's."""
    rows = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).filter("_r = 1").drop("_p", "_r")


def merge_lists(rows: DataFrame, more: DataFrame, key: str, col: str) -> DataFrame:
    """Ordered union of a list column with further lists."""
    extra = more.select(key, F.col(col).alias("_more"))
    both = rows.join(extra, key, "left")
    return both.withColumn(col, F.array_union(F.coalesce(col, F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def unknown_keys(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """known, unknown: how many different keys of ``more`` the table has, and how many it lacks; null keys are none."""
    seen = more.select(key).filter(F.col(key).isNotNull()).distinct().join(rows.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return seen.agg(F.count("_in").alias("known"), F.count_if(F.col("_in").isNull()).alias("unknown"))


def dedup_by_hash(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, hash, kept_id, duplicate: the smallest key of each content stays."""
    keyed = rows.select(key, F.sha2(F.col(text).cast("string"), 256).alias("hash"))
    kept = keyed.groupBy("hash").agg(F.min(key).alias("kept_id"))
    return keyed.join(kept, "hash").select(key, "hash", "kept_id", (F.col(key) != F.col("kept_id")).alias("duplicate"))
