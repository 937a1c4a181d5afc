"""op12 files a set once, however many copies of it there are, and moves only signatures that are asked for."""

from pyspark.sql import functions as F

from caregrid.llm import jaccard, signature_tree


def test_keys_of_copies_alone_are_not_filed(spark, monkeypatch):
    texts = ["a b c d e f g h i j", "k l m n o p q r s t", "k l m n o p q r s t u"]
    rows = [(k, texts[min(k // 20, 2)]) for k in range(41)] + [(41, None), (42, "")]
    filed, shared = [], jaccard.shared
    monkeypatch.setattr(jaccard, "shared", lambda df: filed.extend(map(tuple, df.collect())) or shared(df))
    found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: 0 if k < 20 else 20 if k < 41 else k for k in range(43)}
    # 20 copies of the first text share nothing with another set
    assert {n for _, n in filed} and not {k for k, _ in filed} & set(jaccard.shingles(texts[0]).astype("int64").tolist())
    assert len(filed) == len(set(filed)) and len({n for _, n in filed}) == 2


def test_only_asked_signatures_move(spark):
    signs = spark.range(0, 20000, 1, 4).select(F.xxhash64("id").alias("node"), F.lit(1).alias("n"), F.col("id").alias("over"), F.lit(b"x").alias("bits"))
    got = signature_tree._signs_of(signs.filter("over < 7").select("node"), signs.unionByName(signs))
    assert sorted(r.over for r in got.collect()) == list(range(7))
    assert "holds(" in got._jdf.queryExecution().optimizedPlan().toString().split("LeftSemi")[1]
