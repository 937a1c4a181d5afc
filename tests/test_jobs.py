"""Versions, parts and the ingest job: readers beside writers, writes that die, runs that go on."""

import pytest
from caregrid.operators.ingest import IngestJob
from caregrid.operators.retrieval import fixed_chunks
from caregrid.operators.versions import VersionedTable, replace_vintage
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reader_sees_one_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.versions() == []
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), "id", ["v"])
    before = table.read()
    assert table.upsert(spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string"), "id", ["v"]) == 1
    assert rows(before) == [(1, "a"), (2, "b")] and rows(table.read()) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(table.read(0)) == [(1, "a"), (2, "b")]
    table.insert(spark.createDataFrame([(3, "z"), (4, "d"), (4, "d")], "id long, v string"), "id")
    assert rows(table.read()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    table.drop_before(2)
    assert table.versions() == [2]


def test_unfinished_write_is_not_read(spark, tmp_path):
    """A write that died leaves a folder without its mark; the next write takes its number. A finished number is not written twice."""
    table = VersionedTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    table.write(one)
    died = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception, match="division"):
        table.write(one.select(died("id").alias("id"), "v"))
    assert table.versions() == [0] and rows(table.read()) == [(1, "a")]
    assert table.write(one.withColumn("v", F.lit("b"))) == 1
    assert table.write(one.withColumn("v", F.lit("lost")), number=1) == 1
    assert rows(table.read()) == [(1, "b")]


def test_other_vintages_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", F.year("l_shipdate").alias("year"))
    replace_vintage(lines, path, "year")
    names = lambda: {p.relative_to(path): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    old = names()
    replace_vintage(lines.filter("year = 1995").withColumn("l_quantity", F.lit(0.0)), path, "year")
    new = names()
    is_1995 = lambda p: "year=1995" in str(p)
    assert {p: t for p, t in old.items() if not is_1995(p)} == {p: t for p, t in new.items() if not is_1995(p)}
    assert not {p for p in old if is_1995(p)} & set(new)
    got = spark.read.parquet(path)
    assert got.count() == lines.count() and got.filter("year = 1995").agg(F.sum("l_quantity")).first()[0] == 0
    assert got.filter("year <> 1995").agg(F.sum("l_quantity")).first()[0] == lines.filter("year <> 1995").agg(F.sum("l_quantity")).first()[0]


@pytest.mark.parametrize("stop", ["register", "start", "index"])
def test_ingest_goes_on(spark, tmp_path, stop):
    """A job that dies between any two steps ends as one that did not; later documents are added, known ones stay."""
    docs = spark.createDataFrame([(1, "a" * 4000), (2, "short"), (3, None), (4, ""), (4, "")], "id long, text string")
    path = str(tmp_path / "job")
    job = IngestJob(spark, path)
    job.register(docs)
    if stop != "register":
        job.start()
    if stop == "index":
        job.index(docs)
    again = IngestJob(spark, path)
    want = [(1, "indexed", 3, None), (2, "indexed", 1, None), (3, "error", 0, "no text"), (4, "indexed", 1, None)]
    assert rows(again.run(docs)) == want
    assert rows(again.chunks().groupBy("id").count()) == [(1, 3), (2, 1), (4, 1)]
    cut = []

    def watched(d):
        cut.extend(r.id for r in d.select("id").collect())
        return fixed_chunks(d)

    more = docs.filter("id <> 3").unionByName(spark.createDataFrame([(3, "now there"), (5, "new")], "id long, text string"))
    later = IngestJob(spark, path, watched)
    assert rows(later.run(more)) == [*want, (5, "indexed", 1, None)] and sorted(cut) == [5]
    later.retry()
    assert (3, "indexed", 1, None) in rows(later.run(more)) and later.chunks().filter("id = 3").count() == 1
