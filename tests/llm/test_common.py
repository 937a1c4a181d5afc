"""What the corpus operators share."""

from pyspark.sql import functions as F

from caregrid.llm import common


def test_written_leaves_no_shuffle_files(spark):
    """A written table needs no shuffle files of its making; they go at once, and the session's setting stays as it was."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    setting, before = spark.conf.get(common.CLEANUP), shuffles()
    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    held = common.written(rows, "test")
    assert sorted(r.k for r in held.collect()) == list(range(7))
    assert not shuffles() - before
    assert spark.conf.get(common.CLEANUP) == setting


def test_one_each_keeps_lone_rows_in_place(spark):
    """Rows alone in their component pass without a join; of others the first stays."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(500)] + [(3, "text 3"), (None, "text 9")], "doc_id long, text string")
    rows = common.keyed_rows(docs)
    found = rows.select("_id", "_k1", "_k2", F.when(F.col("_text") == "text 9", -1).otherwise(F.floor(F.col("_id") / 2)).cast("long").alias("root"))
    want = {k for k in range(0, 500, 2)} | {9}  # 8 stays alone, as 9 is with the null id
    assert sorted(r.doc_id for r in common.one_each(rows, found).collect()) == sorted(want)
