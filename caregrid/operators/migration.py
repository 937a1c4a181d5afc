"""Migration of several tables of JSON texts in one verified step.

A run writes each table whole, old rows and new, into a folder of the run. Rows are counted while they are written; how many
there must be is counted apart, from the keys of both sides. Only if all tables agree is the marker
written, and only marked runs are ever read, so a run that dies or loses rows leaves the tables as they were.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .scans import migrated
from .versions import folder


@dataclass
class Move:
    """One table: rows with a key and a JSON text, the schema of its fields, which of them are zoned times, and a last change of the rows."""

    rows: DataFrame
    key: str
    body: str
    schema: str
    times: list[str] = field(default_factory=list)
    change: Callable[[DataFrame], DataFrame] | None = None


class Migration:
    """Migrated tables under ``path``. Repeated keys are one row, and so are null keys; an empty table is written empty."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self, marked: bool = True) -> list[int]:
        """Runs in order; those that were not verified only if asked for."""
        fs, at, path = folder(self.spark, self.path)
        if not fs.exists(at):
            return []
        numbers = [int(m[1]) for m in (re.fullmatch(r"run-(\d+)", s.getPath().getName()) for s in fs.listStatus(at)) if m]
        return sorted(n for n in numbers if not marked or fs.exists(path(f"{self.path}/run-{n}/verified/_SUCCESS")))

    def read(self, name: str) -> DataFrame | None:
        """A table as the newest verified run that has it left it."""
        fs, _, path = folder(self.spark, self.path)
        for n in reversed(self.runs()):
            if fs.exists(path(f"{self.path}/run-{n}/tables/{name}")):
                return self.spark.read.parquet(f"{self.path}/run-{n}/tables/{name}")
        return None

    def run(self, moves: dict[str, Move]) -> DataFrame:
        """table, held, added, expected, agreed; the run counts if all tables agree."""
        at = f"{self.path}/run-{max(self.runs(marked=False), default=-1) + 1}"
        counts = []
        for name, m in moves.items():
            old, seen = self.read(name), Observation()
            fresh = migrated(m.rows, m.rows.limit(0) if old is None else old, m.key, m.body, m.schema, m.times)
            fresh = m.change(fresh) if m.change else fresh
            fresh = fresh.withColumn("_new", F.lit(1))
            whole = fresh if old is None else old.withColumn("_new", F.lit(0)).unionByName(fresh)
            whole = whole.observe(seen, F.count_if(F.col("_new") == 0).alias("held"), F.count_if(F.col("_new") == 1).alias("added"))
            whole.drop("_new").write.parquet(f"{at}/tables/{name}")
            keys = m.rows.select(m.key) if old is None else m.rows.select(m.key).unionByName(old.select(m.key))
            got = seen.get
            counts.append((name, got["held"], got["added"], keys.distinct().count()))
        out = self.spark.createDataFrame(counts, "name string, held long, added long, expected long").withColumn("agreed", F.expr("held + added = expected"))
        if all(held + added == expected for _, held, added, expected in counts):
            out.write.parquet(f"{at}/verified")
        return out
