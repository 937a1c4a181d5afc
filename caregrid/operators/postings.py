"""Text search over written postings: BM25 with terms in order of rarity and an early stop.

The postings of a term lie together, sorted by term, with the length of each text and the term's count; the dictionary
has each term's number of texts and the largest part of a score that it can give. A term that more than HOT texts
hold is cut into parts by a hash of the text, so no join key has more than about HOT rows. A text's counts are made in its own row, and
are shuffled once, to their place in the postings.

A search takes the postings of its terms, and joins the rare ones first. What frequent terms could add at most is then known, and a query whose
k-th best score is above that is closed: no text without one of its rare terms can enter, so frequent terms
are looked up for its candidates only. For other queries the postings of all their terms are dealt by text, once for all queries, and scores are added up
where they lie. The result is the same as that of ``bm25``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import write, written

HOT = 1 << 14
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Postings:
    """A written set of postings under ``path``: postings/, terms/ and texts/."""

    path: str
    n: int
    mean: float
    hot: int

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{part}")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def _counted(docs: DataFrame) -> DataFrame:
    """id, len, term, tf: a row a text and term."""
    rows = docs.select("id", F.lower("text").alias("_low"))
    find = re.compile("[a-z0-9]{2,}").findall

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for i in range(batch.num_rows):  # a text may be long
                words = find(texts[i].as_py() or "")
                if words:
                    held = Counter(words)
                    n = len(held)
                    columns = [batch.column(0).slice(i, 1).take(pa.array(np.zeros(n, np.int64))), pa.array([len(words)] * n, pa.int32()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
                    yield pa.record_batch(columns, ["id", "len", "term", "tf"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, len int, term string, tf long")


def _weight(mean: float) -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))


def write_postings(docs: DataFrame, path: str, hot: int = HOT) -> Postings:
    """Writes docs(id, text) as postings (term, part, id, tf, len), terms (term, df, parts, most, idf) and texts (id, text); a null text counts, but has no terms.

    Rows with one id and as many words are one text.
    """
    spark, (n, mean) = docs.sparkSession, docs.select(words("text").alias("w")).agg(F.count("*"), F.avg(F.size("w"))).first()
    # only frequent terms have parts; they are few, a ``hot``-th of all postings at most
    many = _counted(docs).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    many = written(many.select("term", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "frequent")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    placed = _counted(docs).join(F.broadcast(many), "term", "left").select("term", part.alias("part"), "id", "len", "tf").repartition("term", "part")
    posted = placed.groupBy("term", "part", "id", "len").agg(F.sum("tf").alias("tf"))
    write(posted.select("term", "part", "id", "tf", "len").sortWithinPartitions("term", "part"), f"{path}/postings")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"), F.max(_weight(mean)).alias("_w")).join(F.broadcast(many), "term", "left")
    write(terms.select("term", "df", F.coalesce("parts", F.lit(1)).alias("parts"), (idf * F.col("_w")).alias("most"), idf.alias("idf")), f"{path}/terms")
    write(docs.select("id", "text"), f"{path}/texts")
    return Postings(path, n, mean or 0.0, hot)


def search(spark: SparkSession, store: Postings, queries: DataFrame, k: int) -> DataFrame:
    """queries(q, text) -> q, id, score, place; a query of which no term is known finds the first k texts by id that hold it whole, with score 1."""
    asked = queries.select("q", "text")
    split = asked.select("q", F.explode(F.array_distinct(words("text"))).alias("term"))
    # the stated queries' words, fewer than the dictionary's, go to all tasks: of the postings and the dictionary no other rows move
    named = store.read(spark, "terms").join(F.broadcast(split.select("term").distinct()), "term", "left_semi")
    terms = written(split.join(F.broadcast(named), "term"), "terms")
    posted = store.read(spark, "postings").join(F.broadcast(terms.select("term", "idf").distinct()), "term").select("term", "part", "id", (F.col("idf") * _weight(store.mean)).alias("s"))
    posted = written(posted, "asked")
    rare, frequent = terms.filter("parts = 1"), terms.filter("parts > 1")
    first = written(posted.join(F.broadcast(rare.select("q", "term")), "term").groupBy("q", "id").agg(F.sum("s").alias("s")), "first")
    kth = first.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).filter(F.col("_r") == k).select("q", F.col("s").alias("kth"))
    more = frequent.groupBy("q").agg(F.sum("most").alias("more"))
    state = more.join(kth, "q", "left").select("q", "more", "kth", (F.coalesce("kth", F.lit(0.0)) > F.col("more") + 1e-5).alias("closed"))
    state = written(state, "state")
    closed = state.filter("closed")
    # of a closed query's candidates those stay that what is left could lift to the k-th best
    near = first.join(closed, "q").filter(F.col("s") + F.col("more") + 1e-5 >= F.col("kth")).select("q", "id", "s")
    looked = near.join(frequent.select("q", "term", "parts"), "q").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    looked = looked.select("q", "id", "term", "part").join(posted, ["term", "part", "id"]).select("q", "id", "s")
    rest = first.join(state, "q", "left_anti").select("q", "id", "s")
    score = F.round(F.sum("s"), 6).alias("score")
    total = near.unionByName(looked).unionByName(rest).groupBy("q", "id").agg(score)
    # a text's postings meet once, for all open queries
    opened = terms.select("q", "term").join(state.filter("NOT closed"), "q", "left_semi")
    held = posted.join(F.broadcast(opened.select("term").distinct()), "term", "left_semi").repartition("id")
    total = total.unionByName(held.join(F.broadcast(opened), "term").groupBy("id", "q").agg(score).select("q", "id", "score"))
    best = _placed(total, k).select("q", "id", "score")  # a row a task and place moves
    return _placed(best.unionByName(_holding(spark, store, asked.join(terms, "q", "left_anti"), k)), k)


def _holding(spark: SparkSession, store: Postings, asked: DataFrame, k: int) -> DataFrame:
    """q, id, score of texts that hold the whole query, in any case; the stated queries meet all texts as one list, which is small or none."""
    wanted = asked.filter("trim(text) <> ''").agg(F.collect_list(F.struct("q", F.lower("text").alias("t"))).alias("_asked"))
    low = F.lower("text")
    held = store.read(spark, "texts").crossJoin(F.broadcast(wanted)).select("id", F.explode(F.filter("_asked", lambda a: F.contains(low, a["t"]))).alias("a"))
    first = held.select("a.q", "id").withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("id"))).filter(F.col("_r") <= k)
    return first.select("q", "id", F.lit(1.0).alias("score"))


def _placed(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
