from caregrid.operators import graph, notes, retrieval, tables
from pyspark.sql import functions as F


def test_rerank_takes_a_scorer(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11)], "q int, id int")
    asked = spark.createDataFrame([(1, "one two")], "q int, text string")
    docs = spark.createDataFrame([(10, "one two"), (11, "one two three and four")], "id int, text string")
    by = lambda *a: [r.id for r in retrieval.rerank(pairs, asked, docs, 1, *a).collect()]
    assert by() == [10] and by(lambda q, t: F.length(t).cast("double")) == [11]


def test_embed_new(spark):
    texts = spark.createDataFrame([(1, "a b", "x"), (2, "new", None), (2, "newer", None), (3, "c", "skip"), (4, None, "x"), (None, "n", "x")], "id int, text string, tag string")
    seen = lambda t: t.select("id", F.col("text").alias("vec"))
    got = retrieval.embed_new(texts, spark.createDataFrame([(1,)], "id int"), ["skip"], seen)
    assert {(r.id, r.vec) for r in got.collect()} == {(2, "new"), (4, None)}


def test_scores(spark):
    hits = spark.createDataFrame([(1, 1, 3.0), (1, 2, -1.5), (2, 1, 0.5), (2, 2, -0.5), (2, 3, 0.0), (3, 1, None)], "q int, id int, score double")
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "q int")
    assert {r.q: r.retrieval for r in retrieval.mean_scores(queries, hits).collect()} == {1: 0.25, 2: 0.25, 3: 0.0, 4: 0.0}
    assert {(r.q, r.id): r.ratio for r in retrieval.scaled_scores(hits).filter("q = 1").collect()} == {(1, 1): 0.95, (1, 2): 0.0}


def test_chunk_report_and_hash(spark):
    hits = spark.createDataFrame([(1, 5, 0.5, 1), (1, 6, 0.4, 2)], "q int, id int, score double, place int")
    chunks = spark.createDataFrame([(5, "s", "t", "y" * 301)], "id int, source string, tag string, text string")
    assert [tuple(r) for r in retrieval.chunk_report(hits, chunks).orderBy("rank").collect()] == [(1, 1, 0.5, "s", "t", "y" * 300), (1, 2, 0.4, None, None, None)]
    report = spark.createDataFrame([(1, 0.5, "fine")], "note int, overall double, summary string")
    assert notes.signed_report(report, spark.createDataFrame([(1, None)], "note int, text string")).first().note_hash == "e3b0c44298fc1c14"


def test_edges_and_sizes(spark):
    edges = spark.createDataFrame([("a", "b", " mentions "), ("a", "c", "BELONGS_TO"), ("a", "d", "no way"), ("a", "e", None)], "src string, dst string, type string")
    ok, rejected = graph.typed_edges(edges)
    assert {(r.dst, r.type) for r in ok.collect()} == {("b", "MENTIONS"), ("c", "BELONGS_TO")}
    assert {(r.dst, r.reason) for r in rejected.collect()} == {("d", "malformed"), ("e", "no type")}
    assert {(r.dst, r.reason) for r in graph.typed_edges(edges, ["MENTIONS"])[1].collect()} == {("c", "unknown"), ("d", "malformed"), ("e", "no type")}
    vectors = spark.createDataFrame([("s",), ("s",), (None,)], "source string")
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "node string")
    assert {r.what: r.n for r in graph.graph_size(nodes, edges, ["BELONGS_TO"], vectors).collect()} == {"nodes": 2, "edges": 4, "relations": 3, "vectors:s": 2, "vectors:": 1}
    assert {r.what: r.n for r in graph.graph_size(nodes.limit(0), edges.limit(0), [], vectors.limit(0)).collect()} == {"nodes": 0, "edges": 0, "relations": 0}
    ids = spark.createDataFrame([(1,), (2,)], "k int")
    assert tuple(tables.unknown_keys(ids, spark.createDataFrame([(2,), (2,), (9,), (None,)], "k int"), "k").first()) == (1, 1)
