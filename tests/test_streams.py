"""Streams row by row: decisions in and out of order, replayed batches, repeated content, late rows."""

import shutil
from datetime import datetime, timedelta

import pytest
from caregrid.operators.versions import VersionedTable
from caregrid.streaming import cards, jobs
from pyspark.sql import functions as F

T = datetime(2024, 5, 1)
@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


CARD = "id string, card string, decision string, ts timestamp"


def add(spark, tmp_path, n, rows, schema):
    """One more file of the stream's folder; files are taken in order of time, one a batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
    (file,) = (tmp_path / f"part{n}").glob("part-*")
    (tmp_path / "in").mkdir(exist_ok=True)
    shutil.copy(file, tmp_path / "in" / f"{n:03d}.parquet")


def answers(spark, tmp_path, checkpoint, keep="900 days"):
    stream = spark.readStream.schema(CARD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cards_ = cards.CardStream(spark, str(tmp_path / "cards"), keep)
    cards_.run(stream, str(tmp_path / checkpoint)).awaitTermination()
    return sorted(((r.id, r.card, r.outcome, r.held, r.decided_at) for r in cards_.answers().collect()), key=str)


def test_card_decisions(spark, tmp_path):
    """Approved once; later decisions are refused or repeated; batches out of order and a batch twice change nothing that counted."""
    at = lambda h: T + timedelta(hours=h)
    one = [("e1", "a", "approved", at(5)), ("e2", "a", "rejected", at(6)), ("e3", "b", " Rejected ", at(2)), ("e4", "c", "later", at(1)), ("e5", None, "approved", at(1))]
    early = [("e6", "a", "rejected", at(1)), ("e7", "b", "rejected", at(3)), ("e8", "c", "approved", at(9)), ("e9", "c", "rejected", at(8))]
    add(spark, tmp_path, 0, one, CARD)
    add(spark, tmp_path, 1, early, CARD)
    add(spark, tmp_path, 2, one, CARD)  # the first batch once more
    a, b, c, none = ("approved", at(5)), ("rejected", at(2)), ("rejected", at(8)), ("approved", at(1))
    want = [
        ("e1", "a", "accepted", *a), ("e2", "a", "refused", *a), ("e3", "b", "accepted", *b), ("e4", "c", "unknown", None, None), ("e5", "", "accepted", *none),
        ("e6", "a", "refused", *a), ("e7", "b", "repeated", *b), ("e9", "c", "accepted", *c), ("e8", "c", "refused", *c),
        ("e1", "a", "repeated", *a), ("e2", "a", "refused", *a), ("e3", "b", "repeated", *b), ("e4", "c", "unknown", *c), ("e5", "", "repeated", *none),
    ]
    got = answers(spark, tmp_path, "c0")
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert answers(spark, tmp_path, "c0") == got  # nothing new, nothing again
    assert answers(spark, tmp_path, "another") == got  # all batches once more, from the first
    add(spark, tmp_path, 3, [("f1", "a", "rejected", at(99)), ("f2", "d", "approved", at(99))], CARD)
    more = answers(spark, tmp_path, "c0")
    assert len(more) == len(got) + 2 and ("f1", "a", "refused", *a) in more and ("f2", "d", "accepted", "approved", at(99)) in more


def test_first_decisions_rows(spark):
    rows = [("e1", "a", "approved", T + timedelta(hours=5)), ("e2", "a", "rejected", T), ("e3", "b", "rejected", T)]
    got = jobs.first_decisions(spark.createDataFrame(rows, CARD), "card", "decision", "ts").collect()
    assert sorted(map(tuple, got)) == [("a", "rejected", T, 2), ("b", "rejected", T, 1)]


def test_ingest_unique(spark, tmp_path):
    """Content enters once, within a batch, across batches and past the watermark; a batch that runs again adds nothing."""
    schema = "id long, text string, ts timestamp"
    at = lambda d: T + timedelta(days=d)
    add(spark, tmp_path, 0, [(1, "one", at(0)), (2, "one", at(0)), (3, "two", at(0))], schema)
    add(spark, tmp_path, 1, [(4, "two", at(0)), (5, "three", at(9)), (6, None, at(9))], schema)
    add(spark, tmp_path, 2, [(7, "one", at(20)), (8, "four", at(20))], schema)  # beyond the watermark's memory
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "table")
    texts = lambda: sorted((r.text for r in VersionedTable(spark, path).read().collect()), key=str)
    jobs.ingest_unique(stream, "ts", "text", path, str(tmp_path / "c")).awaitTermination()
    assert texts() == sorted([None, "one", "two", "three", "four"], key=str)
    versions = VersionedTable(spark, path).versions()
    # the last batch's mark is lost, as if its run had died after its write
    shutil.copytree(tmp_path / "c", tmp_path / "c2")
    last = max(int(p.name) for p in (tmp_path / "c2" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "c2" / "commits" / name).unlink(missing_ok=True)
    jobs.ingest_unique(stream, "ts", "text", path, str(tmp_path / "c2")).awaitTermination()
    assert texts() == sorted([None, "one", "two", "three", "four"], key=str) and set(versions) <= set(VersionedTable(spark, path).versions())


def test_unique_documents_state(spark, tmp_path):
    """The stream alone: repeats within the watermark go, in one batch and across batches."""
    schema = "id long, text string, ts timestamp"
    add(spark, tmp_path, 0, [(1, "one", T), (3, "two", T)], schema)
    add(spark, tmp_path, 1, [(4, "two", T), (5, "three", T)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.unique_documents(stream, "ts", "text").writeStream.format("memory").queryName("unique_docs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("unique_docs").select("id", "text", F.col("hash") == F.sha2("text", 256))
    assert sorted(map(tuple, got.collect())) == [(1, "one", True), (3, "two", True), (5, "three", True)]


def test_cards_are_forgotten(spark, tmp_path):
    """A card of which nothing was heard for long is open again; others are not."""
    store = cards.CardStream(spark, str(tmp_path / "cards"), "30 days")
    batch = lambda rows: spark.createDataFrame(rows, CARD)
    store.step(batch([("e1", "a", "approved", T), ("e2", "b", "approved", T + timedelta(days=20))]), 0)
    store.step(batch([("e3", "c", "approved", T + timedelta(days=40))]), 1)
    store.step(batch([("e4", "a", "rejected", T + timedelta(days=41)), ("e5", "b", "rejected", T + timedelta(days=41)), ("e5", "b", "rejected", T + timedelta(days=41))]), 2)
    got = sorted((r.id, r.outcome, r.held) for r in store.answers().filter("batch = 2").collect())
    assert got == [("e4", "accepted", "rejected"), ("e5", "refused", "approved"), ("e5", "refused", "approved")]
    assert sorted((r.card, r.held) for r in store.table.read().collect()) == [("a", "rejected"), ("b", "approved"), ("c", "approved")]
