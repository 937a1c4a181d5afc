"""Joins of texts by what they hold, without comparing all pairs.

A needle that a text holds has all its character trigrams there, so it is filed under the one that the fewest
texts have, joined on it with the texts that have it, and checked. Each needle is filed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int = 3) -> Column:
    """The different runs of n characters; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needles(needle), texts(text), different ones each -> needle, text of all pairs in which the text holds the needle; blank needles match nothing."""
    asked = needles.filter(F.length("needle") > 0).select("needle", F.least(F.length("needle"), F.lit(3)).alias("_n"))
    sizes = [r[0] for r in asked.select("_n").distinct().collect()]  # three at most
    own = F.when(F.col("_n") == 3, grams(F.col("needle"))).when(F.col("_n") == 2, grams(F.col("needle"), 2)).otherwise(F.array("needle"))
    held = texts.select("text", F.explode(F.concat(F.array().cast("array<string>"), *[grams(F.col("text"), n) for n in sizes])).alias("gram"))
    used = held.groupBy("gram").agg(F.count("*").alias("df"))
    spread = asked.select("needle", F.explode(own).alias("gram")).join(used, "gram", "left").fillna({"df": 0})
    filed = spread.groupBy("needle").agg(F.min(F.struct("df", "gram")).alias("_g")).filter("_g.df > 0").select("needle", F.col("_g.gram").alias("gram"))
    return filed.join(held, "gram").filter(F.contains("text", F.col("needle"))).select("needle", "text")


def sharing(sets: DataFrame, texts: DataFrame, least: Column) -> DataFrame:
    """sets(name, words), texts(text, words), different ones each -> name, text of all pairs that share ``least`` (of words) words or more.

    All but ``least`` - 1 words of a set must hold one that is shared, so a set is filed under so many of its rarest.
    """
    held = texts.select("text", F.explode(F.array_distinct("words")).alias("word"))
    used = held.groupBy("word").agg(F.count("*").alias("df"))
    need = sets.select("name", F.array_distinct("words").alias("words")).filter(F.size("words") > 0).withColumn("_need", least)
    spread = need.select("name", "_need", F.size("words").alias("_m"), F.explode("words").alias("word")).join(used, "word", "left").fillna({"df": 0})
    rarest = spread.groupBy("name", "_need", "_m").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("_w"))
    filed = rarest.select("name", "_need", F.explode(F.slice("_w", F.lit(1), F.greatest(F.col("_m") - F.col("_need") + 1, F.lit(1)))).alias("_w")).select("name", "_need", F.col("_w.word").alias("word"))
    met = filed.join(held, "word").select("name", "text", "_need").distinct()
    full = met.join(need.select("name", "words"), "name").join(texts.select("text", F.col("words").alias("_t")), "text")
    return full.filter(F.size(F.array_intersect("words", "_t")) >= F.col("_need")).select("name", "text")
