"""Vector and text retrieval for a table of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import confidence_label
from .vectors import top_k


def merge_ranked(ranked: DataFrame, k: int) -> DataFrame:
    """ranked(q, tier, place, id): lists in order of tier, first occurrence of an id kept, cut at k."""
    once = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("q", "id").orderBy("tier", "place"))).filter("_r = 1")
    w = Window.partitionBy("q").orderBy("tier", "place", "id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "id", "tier", "rank")


def hit_at_1(hits: DataFrame, accepted: DataFrame) -> DataFrame:
    """Whether the first hit of each query is among its accepted ids; passed and failed counts."""
    first = hits.filter("place = 1").join(accepted, "q")
    ok = F.array_contains("ids", F.col("id"))
    return first.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries(q, text), docs(id, text) -> q, id, score, place by BM25 over lower-case words of two letters or more.

    Only terms that queries use are joined; a term that most documents hold weighs little but is still counted.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    split = docs.select("id", words("text").alias("w"))
    stats = split.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    terms = queries.select("q", F.explode(F.array_distinct(words("text"))).alias("term"))
    used = terms.select("term").distinct()
    tf = split.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).join(used, "term", "left_semi").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats)).select("id", "term", part.alias("s")).join(terms, "term")  # stats: one row
    total = scored.groupBy("q", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return total.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(query), words(text))), F.size(words(query))), F.lit(0.0))


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """candidates(q, id), queries(q, text), docs(id, text) -> q, id, score, place: the k with the best score, ties by id. ``scorer`` takes the query's text and the document's; a pandas UDF of a trained model will do."""
    pairs = candidates.select("q", "id").join(queries.select("q", F.col("text").alias("_asked")), "q").join(docs.select("id", F.col("text").alias("_text")), "id")
    scored = pairs.select("q", "id", F.round(scorer(F.col("_asked"), F.col("_text")), 9).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def scaled_scores(hits: DataFrame, best: Column | None = None) -> DataFrame:
    """hits(q, id, score) with ratio, the share of the query's best score times 0.95, and unit, the score itself where the best is within 1.5, else its share; both in 0 to 1. ``best`` stands for the best score."""
    best = F.max("score").over(Window.partitionBy("q")) if best is None else best
    share = F.try_divide(F.col("score"), best)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return hits.withColumns({"ratio": clamp(share * 0.95), "unit": F.when(best <= 1.5, clamp(F.col("score"))).otherwise(share)})


def mean_scores(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """q, retrieval of every row of queries(q): the mean unit score of its hits. Scores that are null or zero are not scores; without any the mean is 0."""
    found = scaled_scores(hits.filter("score <> 0")).groupBy("q").agg(F.round(F.avg("unit"), 6).alias("retrieval"))
    return queries.select("q").join(found, "q", "left").fillna({"retrieval": 0.0})


def chunk_report(hits: DataFrame, chunks: DataFrame, most: int = 300) -> DataFrame:
    """hits(q, id, score, place), chunks(id, source, tag, text) -> q, rank, score, source, tag, excerpt: the first ``most`` characters. Hits without a chunk have nulls there."""
    shown = chunks.select("id", "source", "tag", F.substring("text", 1, most).alias("excerpt"))
    return hits.join(shown, "id", "left").select("q", F.col("place").alias("rank"), "score", "source", "tag", "excerpt")


def grounding(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits(q, score, source, curated), queries(q, coverage, reasoned) -> q, overall, parts of it and a label.

    0.4 retrieval + 0.3 coverage + 0.2 diversity + 0.1 reasoning; curated hits lift retrieval and coverage to a floor.
    A query without hits has no retrieval and no diversity.
    """
    top = F.max("score").over(Window.partitionBy("q"))
    unit = F.when(top > 1.5, F.col("score") / top).otherwise(F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)))
    found = hits.withColumn("_unit", unit).groupBy("q").agg(F.avg("_unit").alias("r"), F.count_if("curated").alias("c"), F.count_distinct("source").alias("s"))
    rows = queries.join(found, "q", "left").fillna({"r": 0.0, "c": 0, "s": 0})
    floor = lambda col, one, two: F.when(F.col("c") >= 2, F.greatest(F.col(col), F.lit(two))).when(F.col("c") == 1, F.greatest(F.col(col), F.lit(one))).otherwise(F.col(col))
    rows = rows.select("q", floor("r", 0.75, 0.9).alias("r"), floor("coverage", 0.7, 0.85).alias("k"), F.least(F.col("s") / 3, F.lit(1.0)).alias("v"), F.col("reasoned").cast("double").alias("t"))
    overall = F.round(F.col("r") * 0.4 + F.col("k") * 0.3 + F.col("v") * 0.2 + F.col("t") * 0.1, 3)
    rounded = [F.round(c, 3).alias(name) for c, name in (("r", "retrieval"), ("k", "coverage"), ("v", "diversity"))]
    return rows.select("q", overall.alias("overall"), *rounded).withColumn("label", confidence_label(F.col("overall")))


def tool_grounding(calls: DataFrame, most_rounds: int) -> DataFrame:
    """calls(q, bytes, round) of tools -> q, calls, bytes, overall, label of answers that rest on tools' results.

    High: more than 500 bytes before the last round; medium: more than 100; low: less. A null length is none, a null round the first.
    """
    told = calls.groupBy("q").agg(F.count("*").alias("calls"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.max(F.coalesce("round", F.lit(1))).alias("_r"))
    high, medium = (F.col("bytes") > 500) & (F.col("_r") < most_rounds), F.col("bytes") > 100
    return told.select("q", "calls", "bytes", F.when(high, 0.95).when(medium, 0.7).otherwise(0.35).alias("overall"), F.when(high, "High").when(medium, "Medium").otherwise("Low").alias("label"))


def fixed_chunks(docs: DataFrame, size: int = 2000, overlap: int = 500) -> DataFrame:
    """docs(id, text) -> id, chunk, text: windows of a fixed size; an empty text is one empty chunk."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length("text") - overlap) / F.lit(float(step))), F.lit(1)).cast("int")
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).select("id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("id", "chunk", F.substring("text", F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def embed(texts: DataFrame, dim: int = 64) -> DataFrame:
    """texts(id, text) -> id, vec: counts of hashed lower-case words of two letters or more, of length one.

    Stands in for a trained encoder: any function of this shape will do for the search. Words are counted a bucket
    before they are shuffled. A text without words has a vector of zeros.
    """
    words = F.array_compact(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    spread = texts.select("id", F.explode_outer(words).alias("w"))
    bucket = (F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("int") % dim).alias("b")
    counted = spread.select("id", bucket).groupBy("id", "b").agg(F.count("b").alias("n"))
    whole = counted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", F.col("n").cast("double"))))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    return whole.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("l")), F.lit(0.0))).alias("vec"))


def embed_new(texts: DataFrame, done: DataFrame, skip: list[str], encoder: Callable[[DataFrame], DataFrame] = embed) -> DataFrame:
    """id, vec of texts(id, text, tag) whose id done(id) lacks and whose tag is not in ``skip``; ``encoder`` takes id and text. Of an id's texts the smallest is taken; null ids go."""
    fresh = texts.filter(F.col("id").isNotNull() & ~F.coalesce(F.col("tag").isin(skip), F.lit(False))).join(done.select("id"), "id", "left_anti")
    return encoder(fresh.groupBy("id").agg(F.min("text").alias("text")))


def retrieve(queries: DataFrame, docs: DataFrame, curated: list[Column], k: int = 8, own: int = 2) -> DataFrame:
    """queries(q, text, qvec), docs(id, text, vec) -> q, id, tier, rank: the curated parts' best ``own``, then the reranked best of all.

    Of max(3n, 15) candidates by vector, the n with the most of the query's words stay, n being the larger of k less the
    curated places and half of k. An id that two parts give keeps its first place.
    """
    asked, vectors = queries.select("q", "qvec"), docs.select("id", "vec")
    general = max(k - own * len(curated), k // 2)
    lists = [top_k(asked, docs.filter(part).select("id", "vec"), own).select("q", "id", "place", F.lit(t).alias("tier")) for t, part in enumerate(curated)]
    best = rerank(top_k(asked, vectors, max(3 * general, 15)), queries, docs, general)
    return merge_ranked(reduce(DataFrame.unionByName, [*lists, best.select("q", "id", "place", F.lit(len(curated)).alias("tier"))]), k)


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that the text has, longer pieces at the next ones.

    Pieces keep their separator in front; neighbours share whole pieces of up to ``overlap`` characters; blank chunks go.
    """
    at = next(i for i, s in enumerate([*separators, ""]) if not s or s in text)
    sep, finer = [*separators, ""][at], separators[at + 1 :]
    head, *tail = text.split(sep) if sep else [""]
    pieces = [p for p in [head, *(sep + t for t in tail)] if p] if sep else list(text)
    chunks: list[str] = []
    window: list[str] = []
    held = 0
    for piece in [*pieces, None]:
        whole = piece is None or (len(piece) >= size and sep)
        if window and (whole or held + len(piece) > size):
            chunks.append("".join(window).strip())
            first = len(window) if whole else 0
            while first < len(window) and (held > overlap or held + len(piece) > size):
                held -= len(window[first])
                first += 1
            window = window[first:]
            held = 0 if whole else held
        if piece is not None and whole:
            chunks += split_text(piece, size, overlap, finer) if len(piece) > size or finer else [piece.strip()]
        elif piece is not None:
            window.append(piece)
            held += len(piece)
    return [c for c in chunks if c]


def recursive_chunks(docs: DataFrame, size: int = 2000, overlap: int = 500, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> DataFrame:
    """docs(id, text) -> id, chunk, text by split_text; a blank or null text is one placeholder chunk."""

    def run(frames):
        for frame in frames:
            frame["text"] = [split_text(t, size, overlap, list(separators)) if t and t.strip() else ["[Empty document]"] for t in frame["text"]]
            frame["chunk"] = [list(range(len(c))) for c in frame["text"]]
            yield frame[["id", "chunk", "text"]].explode(["chunk", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInPandas(run, f"id {kind}, chunk int, text string")


def ingest_status(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs(id, text), chunks(id) -> id, status, chunks, error: a text that cannot be read (null) is an error without chunks."""
    counted = chunks.groupBy("id").agg(F.count("*").alias("chunks"))
    bad = F.col("text").isNull()
    status = F.when(bad, "error").when(F.col("chunks").isNull(), "pending").otherwise("indexed")
    rows = docs.join(counted, "id", "left")
    return rows.select("id", status.alias("status"), F.when(bad, 0).otherwise(F.coalesce("chunks", F.lit(0))).alias("chunks"), F.when(bad, "no text").alias("error"))
