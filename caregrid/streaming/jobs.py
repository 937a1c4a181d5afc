"""Streaming forms of the log operators: windows with watermarks, dedup, first decisions, incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import insert_absent
from ..operators.versions import VersionedTable


def daily_ratings(stream: DataFrame, time: str, rating: str, late: str = "1 day") -> DataFrame:
    """Positive and negative ratings a day; rows later than the watermark are dropped."""
    days = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"))
    counted = days.agg(F.count_if(F.col(rating) == "positive").alias("positive"), F.count_if(F.col(rating) == "negative").alias("negative"))
    return counted.select(F.to_date("w.start").alias("day"), "positive", "negative")


def unique_documents(stream: DataFrame, time: str, text: str, late: str = "1 day") -> DataFrame:
    """The first document of each content within the watermark, with its hash."""
    hashed = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("hash", F.sha2(F.col(text).cast("string"), 256))
    return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["hash"])


def first_decisions(stream: DataFrame, card: str, decision: str, time: str) -> DataFrame:
    """The first decision on each card by time; a card's state is one row however often it is decided on."""
    return stream.groupBy(card).agg(F.min_by(decision, time).alias("decision"), F.min(time).alias("decided_at"), F.count("*").alias("decisions"))


def incremental(source: DataFrame, store: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]):
    """Runs ``work`` on rows of the source whose key the Parquet store does not have, and appends its result.

    Each batch is looked up in the store with an anti join, so that a batch that runs again adds nothing twice.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            done = spark.read.parquet(store).select(key)
        except Exception as e:  # before the first write there is no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        work(fresh if done is None else fresh.join(done, key, "left_anti")).write.mode("append").parquet(store)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_unique(stream: DataFrame, time: str, text: str, path: str, checkpoint: str, late: str = "1 day"):
    """Writes the first document of each content to a versioned table under ``path``, by its hash.

    Repeats within the watermark go in the stream's state, later ones against the table. A batch's version has the
    batch's number, so a batch that runs again, before or after its version was finished, adds nothing twice.
    """
    table = VersionedTable(stream.sparkSession, path)

    def step(batch: DataFrame, number: int) -> None:
        batch.persist().count()  # all of the stream's state is read once, whatever the write below needs
        old, fresh = table.read(), batch.dropDuplicates(["hash"])
        table.write(fresh if old is None else insert_absent(old, fresh, "hash"), number)
        batch.unpersist()

    return unique_documents(stream, time, text, late).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
