"""Exact duplicates by skew-safe combining.

Texts that are identical after lower-casing A-Z form a group; the row with the
largest id stays. A group may hold a third of all rows, so no step ever brings
a group together: each map task first folds its own copies (the partial half of
the first aggregate), salted digest groups are merged next, and only one row a
salt is combined globally. All three steps group by the digest *and* the text,
so rows are merged only where their whole contents are equal.

Null texts count as empty; texts of any length are compared whole. A null id is
below all ids. Rows that repeat id and text are the same document and get the
same answer. Column names other than the id and the text do not matter. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_and_text, written

SALTS = 16
SHA256 = lambda text: F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, norm, keep_id, group_size): one row for each different text."""
    return _groups(_keyed(docs, id_col, text_col, SHA256), salts)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = SHA256) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Groups are made by comparing whole texts, so a digest that only one group has
    stands for one text, and members find that group by the digest alone. That is
    an equi-join with one row a group on its right, so adaptive execution can split a
    hot group. Where several groups share a digest, members find theirs by the text.
    """
    rows = _keyed(docs, id_col, text_col, digest)
    groups = written(_groups(rows, salts).select("digest", "keep_id", "group_size"), "groups")
    shared = groups.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    members = rows.select("_id", "digest", SHA256(F.col("norm")).alias("sha"))
    if shared.isEmpty():
        return _told(members.join(groups, "digest"), id_col)
    shared = written(shared, "shared")
    alone = members.join(groups.join(shared, "digest", "left_anti"), "digest")
    mixed = rows.join(shared, "digest", "left_semi")
    by_text = mixed.withColumn("sha", SHA256(F.col("norm"))).join(_groups(mixed, salts), ["digest", "norm"])
    return _told(alone, id_col).unionByName(_told(by_text, id_col))


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    salted = rows.groupBy("digest", "norm", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("salt")).agg(
        F.max("_id").alias("keep_id"), F.count("*").alias("n")
    )
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col).select("_id", ascii_lower(F.col("_text")).alias("norm"))
    return rows.select("_id", "norm", digest(F.col("norm")).alias("digest"))


def _told(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
