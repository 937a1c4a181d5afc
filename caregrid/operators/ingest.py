"""Ingest of documents as a job that goes on where it stopped.

A state table has a row a document: pending, indexing, indexed or error, with its number of chunks and the
error's text. Each step takes the rows of its state only and writes a new version of the
table. Chunks are written to a folder named by the version they were cut under, whole, so a
step that dies and runs again writes the same chunks over, and a finished step is not repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import fixed_chunks
from .versions import VersionedTable


class IngestJob:
    """States and chunks of documents (id, text) under ``path``; ``chunker`` gives (id, chunk, text)."""

    def __init__(self, spark: SparkSession, path: str, chunker: Callable[[DataFrame], DataFrame] = fixed_chunks) -> None:
        self.spark, self.path, self.chunker = spark, path.rstrip("/"), chunker
        self.table = VersionedTable(spark, f"{self.path}/state")

    def state(self) -> DataFrame:
        return self.table.read()

    def _in(self, docs: DataFrame, status: str) -> DataFrame:
        return docs.join(self.state().filter(F.col("status") == status).select("id"), "id", "left_semi")

    def register(self, docs: DataFrame) -> None:
        """Documents that the job has not met are pending."""
        self.table.insert(docs.select("id", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("chunks"), F.lit(None).cast("string").alias("error")), "id")

    def retry(self) -> None:
        """Documents in error are pending again."""
        failed = self.state().filter("status = 'error'").withColumns({"status": F.lit("pending"), "error": F.lit(None).cast("string")})
        self.table.upsert(failed, "id", ["status", "error"])

    def start(self) -> None:
        """Pending documents are being indexed from here on."""
        self.table.upsert(self.state().filter("status = 'pending'").withColumn("status", F.lit("indexing")), "id", ["status"])

    def index(self, docs: DataFrame) -> DataFrame:
        """Cuts the documents that are being indexed; those without a text, or of which the chunker makes nothing, have no chunks."""
        folder = f"{self.path}/chunks/v={self.table.versions()[-1]}"
        rows = self._in(docs, "indexing").filter("text IS NOT NULL").dropDuplicates(["id"])
        self.chunker(rows.select("id", "text")).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    def finish(self, docs: DataFrame, chunks: DataFrame) -> None:
        """Documents that were being indexed are indexed, or in error with the reason."""
        now = self._in(docs.dropDuplicates(["id"]), "indexing").select("id", F.col("text").isNull().alias("_none"))
        counted = now.join(chunks.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
        reason = F.when(F.col("_none"), "no text").when(F.col("n").isNull(), "no chunks")
        done = counted.select("id", F.when(reason.isNull(), "indexed").otherwise("error").alias("status"), F.coalesce("n", F.lit(0)).alias("chunks"), reason.alias("error"))
        self.table.upsert(done, "id", ["status", "chunks", "error"])

    def run(self, docs: DataFrame) -> DataFrame:
        """All steps; whatever an earlier run left in the middle is taken up first."""
        if (self.state() is not None) and not self.state().filter("status = 'indexing'").isEmpty():
            self.finish(docs, self.index(docs))
        self.register(docs)
        self.start()
        self.finish(docs, self.index(docs))
        return self.state()

    def chunks(self) -> DataFrame:
        """The chunks of indexed documents: of a document cut more than once, those of the last time."""
        held = self.spark.read.parquet(f"{self.path}/chunks").join(self.state().filter("status = 'indexed'").select("id"), "id", "left_semi")
        return held.join(held.groupBy("id").agg(F.max("v").alias("v")), ["id", "v"]).drop("v")
