"""Decisions on cards as a stream: each card is approved or rejected once.

State is a versioned table, one row a card. Each batch joins its rows with the newest version, answers them and
writes the next version, whose number is that of the batch, and its answers to a folder of that number. A batch
that runs again, before or after its version was finished, reads the version before its own and so gives the
same answers. Within a batch a card's decisions are taken in order of time, then of their id; across
batches the first to arrive counts, as it does for one who asks. Every decision is answered:

* ``accepted``: the card was open and is decided now;
* ``repeated``: the verdict that counts came again;
* ``refused``: the card had been decided otherwise;
* ``unknown``: neither approved nor rejected is asked for.

A null card is a card of its own. A card of which no decision was heard for ``keep``, measured against the
latest time of any row so far, is forgotten, and its next decision is taken as the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.versions import VersionedTable

#: What can be decided.
DECISIONS = ("approved", "rejected")


def answered(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """rows(card, id, decision, ts) with outcome, held and decided_at, by the state (card, held, decided_at, heard)."""
    rows = rows.select(F.coalesce(F.col("card").cast("string"), F.lit("")).alias("card"), F.col("id").cast("string").alias("id"), F.lower(F.trim("decision")).alias("decision"), F.col("ts").cast("timestamp").alias("ts"))
    known = F.col("decision").isin(*DECISIONS)
    order = Window.partitionBy("card").orderBy(F.col("ts").asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.withColumns({"_h": F.lit(None).cast("string"), "_t": F.lit(None).cast("timestamp")}) if state is None else rows.join(state.select("card", F.col("held").alias("_h"), F.col("decided_at").alias("_t")), "card", "left")
    first = F.first(F.when(known, F.struct("decision", "ts", "id")), ignorenulls=True).over(order)
    told = before.withColumn("_f", first)
    opens = F.col("_h").isNull() & known & (F.struct("decision", "ts", "id").eqNullSafe(F.col("_f")))
    nth = F.row_number().over(Window.partitionBy("card", "id", "decision", "ts").orderBy("card"))  # of rows alike in all, one opens
    held = F.coalesce("_h", "_f.decision")
    outcome = F.when(~F.coalesce(known, F.lit(False)), "unknown").when(opens & (nth == 1), "accepted").when(F.col("decision") == held, "repeated").otherwise("refused")
    return told.select("card", "id", "decision", "ts", outcome.alias("outcome"), held.alias("held"), F.when(F.col("_h").isNull(), F.col("_f.ts")).otherwise(F.col("_t")).alias("decided_at"))


def next_state(state: DataFrame | None, answers: DataFrame, keep: str) -> DataFrame:
    """The state after these answers, without cards that nothing was heard of for ``keep``."""
    new = answers.filter("held IS NOT NULL").groupBy("card").agg(F.max("held").alias("held"), F.max("decided_at").alias("decided_at"), F.max("ts").alias("heard"))
    both = new if state is None else state.unionByName(new).groupBy("card").agg(F.min_by("held", "decided_at").alias("held"), F.min("decided_at").alias("decided_at"), F.max("heard").alias("heard"))
    newest = both.agg(F.max("heard").alias("_latest"))
    return both.crossJoin(F.broadcast(newest)).filter(F.col("heard").isNull() | (F.col("heard") >= F.col("_latest") - F.expr(f"INTERVAL {keep}"))).drop("_latest")


class CardStream:
    """A stream of decisions and where its state and answers lie."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "30 days") -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.table = VersionedTable(spark, f"{self.path}/state")

    def step(self, batch: DataFrame, number: int) -> None:
        """Answers one batch; doing it again changes nothing."""
        earlier = [v for v in self.table.versions() if v < number]
        state = self.table.read(earlier[-1]) if earlier else None
        answered(batch, state).write.mode("overwrite").parquet(f"{self.path}/answers/batch={number}")
        answers = self.spark.read.parquet(f"{self.path}/answers/batch={number}")
        self.table.write(next_state(state, answers, self.keep), number)

    def run(self, stream: DataFrame, checkpoint: str):
        """stream(card, id, decision, ts): starts the query; its answers are read by ``answers``."""
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def answers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/answers")
