"""Vector search by inner product: an exact scan in one pass, and an index over every row.

A stated set of queries meets all rows in blocks: a block's vectors, at most BLOCK_BYTES of them,
go to every task, which multiplies them with its rows batch by batch and keeps k rows a query. Only
these are shuffled. The index files each row under the nearest COPIES of a bounded number of centroids; a
query probes the lists of its nearest ones and scores their rows exactly, so an index can miss
a row but never gives a wrong score.

Rows or queries without a vector are left out; ties are broken by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20
MOST_LISTS = 1 << 14
LIST_ROWS = 1 << 16
COPIES = 2
PLACES = 9


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Best:
    """The k best rows of each query so far: largest score first, ties by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.held = k, [(np.zeros(0), np.zeros(0, object)) for _ in range(n)]

    def add(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each place in ``asked``, a column for each id."""
        k = min(self.k, scores.shape[1])
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        for q, row, low in zip(asked.tolist(), scores, least.tolist()):
            old, names = self.held[q]
            if len(old) == self.k and low < (low := old[-1]) and row.max() < low:
                continue
            at = np.flatnonzero(row >= low)
            s, names = np.concatenate([old, row[at]]), np.concatenate([names, ids[at]])
            order = sorted(range(len(s)), key=lambda i: (-s[i], names[i]))[: self.k]
            self.held[q] = s[order], names[order]


def _searcher(names: pa.Array, asked: np.ndarray, k: int, probes: list[np.ndarray] | None, kind: pa.DataType):
    """Task function over batches (id, vec) or, with probes, (list, id, vec): q, id, score."""

    def run(batches):
        best = Best(len(asked), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column(batch.num_columns - 2).to_pylist(), object)
            vec = _matrix(batch.column(batch.num_columns - 1))
            if probes is None:
                for a in range(0, len(asked), 1 << 12):
                    best.add(np.arange(a, min(len(asked), a + (1 << 12))), np.round(asked[a : a + (1 << 12)] @ vec.T, PLACES), ids)
                continue
            where = batch.column(0).to_numpy()
            for one in np.unique(where).tolist():
                who = probes[one]
                if len(who):
                    at = np.flatnonzero(where == one)
                    best.add(who, np.round(asked[who] @ vec[at].T, PLACES), ids[at])
        took = np.array([len(s) for s, _ in best.held])
        q = names.take(pa.array(np.repeat(np.arange(len(asked)), took)))
        found = [x for _, n in best.held for x in n.tolist()]
        yield pa.record_batch([q, pa.array(found, kind), pa.array(np.concatenate([np.zeros(0), *(s for s, _ in best.held)]))], ["q", "id", "score"])

    return run


def _blocks(queries: DataFrame):
    """(names, matrix) of bounded size, read from the queries one block after the other."""
    rows = queries.select("q", "qvec").filter("qvec IS NOT NULL")
    total = rows.agg(F.count("*"), F.max(F.size("qvec"))).first()
    n = -(-total[0] * (total[1] or 1) * 8 // BLOCK_BYTES) or 1
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == b).orderBy("q").toArrow().combine_chunks()
        if part.num_rows:
            yield part.column("q").combine_chunks(), _matrix(part.column("qvec").combine_chunks())


def _placed(parts: list[DataFrame], k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def _schema(queries: DataFrame, rows: DataFrame) -> tuple[str, pa.DataType]:
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return f"q {queries.schema['q'].dataType.simpleString()}, id {kind.simpleString()}, score double", to_arrow_type(kind)


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """queries(q, qvec), corpus(id, vec) -> q, id, score (rounded to PLACES), place: exact, largest inner product first, ties by id."""
    rows = corpus.select("id", "vec").filter("vec IS NOT NULL")
    schema, kind = _schema(queries, rows)
    parts = [rows.mapInArrow(_searcher(names, asked, k, None, kind), schema) for names, asked in _blocks(queries)]
    return _placed(parts or [corpus.sparkSession.createDataFrame([], schema)], k)


@dataclass(frozen=True)
class Index:
    """A written index: centroids (one row a list, last coordinate added), the largest length of a vector, the path of the rows, lists a row."""

    centroids: np.ndarray
    longest: float
    path: str
    copies: int


def _lifted(vec: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that all rows have one length and the nearest is the one with the largest inner product."""
    return np.hstack([vec, np.sqrt(np.maximum(longest**2 - (vec**2).sum(axis=1), 0))[:, None]])


def _nearest(vec: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    away = (centroids**2).sum(axis=1) - 2 * vec @ centroids.T
    return np.argpartition(away, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(len(centroids)), (len(vec), 1))


def centroids(rows: DataFrame, lists: int, longest: float, rounds: int) -> np.ndarray:
    """k-means by ``rounds`` passes over all rows; a task sends a sum a list. Starts at the rows with the smallest hashes of their ids."""
    first = rows.orderBy(F.xxhash64("id"), "id").limit(lists).select("vec").toArrow().column("vec").combine_chunks()
    now = _lifted(_matrix(first), longest)
    dim = now.shape[1]
    for _ in range(rounds):

        def run(batches, now=now):
            sums, counts = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                if batch.num_rows:
                    vec = _lifted(_matrix(batch.column(0)), longest)
                    at = _nearest(vec, now)[:, 0]
                    np.add.at(sums, at, vec)
                    counts += np.bincount(at, minlength=len(now))
            used = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], ["list", "n", "s"])

        sent = rows.select("vec").mapInArrow(run, "list long, n long, s array<double>").groupBy("list")
        got = sent.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", k)) for k in range(dim)]).alias("s")).toArrow()
        now = now.copy()  # a list without rows keeps its centroid
        now[got.column("list").to_numpy()] = _matrix(got.column("s").combine_chunks()) / got.column("n").to_numpy()[:, None]
    return now


def write_index(corpus: DataFrame, path: str, lists: int | None = None, rounds: int = 5, copies: int = COPIES) -> Index:
    """Files every row of corpus(id, vec) under its ``copies`` nearest centroids, in order of lists; a list of more than LIST_ROWS rows lies in several files.

    ``lists`` is about the square root of the number of rows where it is not given, MOST_LISTS at most.
    """
    rows = corpus.select("id", "vec").filter("vec IS NOT NULL")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    n, longest = rows.agg(F.count("*"), F.max(length)).first()
    longest = longest or 0.0
    made = centroids(rows, min(lists or int(n**0.5), MOST_LISTS, n), longest, rounds) if n else np.zeros((0, 1))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = _nearest(_lifted(_matrix(batch.column(1)), longest), made, copies)
                for k in range(at.shape[1]):
                    yield pa.record_batch([pa.array(at[:, k]), *batch.columns], ["list", "id", "vec"])

    filed = rows.mapInArrow(run, f"list long, id {rows.schema['id'].dataType.simpleString()}, vec {rows.schema['vec'].dataType.simpleString()}")
    parts = max(1, -(-n * copies // LIST_ROWS))
    # ranges by list and a hash: many rows of one list are cut, and each file's own range of lists lets a search skip it
    filed.withColumn("_h", F.xxhash64("id")).repartitionByRange(parts, "list", "_h").sortWithinPartitions("list").drop("_h").write.parquet(path)
    return Index(made, longest, path, copies)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """q, id, score, place: the k best rows of the ``probes`` lists that are nearest to each query."""
    rows = spark.read.parquet(index.path).select("list", "id", "vec")
    schema, kind = _schema(queries, rows)
    parts = []
    for names, asked in _blocks(queries):
        if not len(index.centroids):
            break
        near = _nearest(np.hstack([asked, np.zeros((len(asked), 1))]), index.centroids, probes)
        who = [np.flatnonzero((near == one).any(axis=1)) for one in range(len(index.centroids))]
        used = [one for one, w in enumerate(who) if len(w)]
        parts.append(rows.filter(F.col("list").isin(used)).mapInArrow(_searcher(names, asked, k * index.copies, who, kind), schema).distinct())
    return _placed(parts or [spark.createDataFrame([], schema)], k)  # a row that lies in several lists counts once
