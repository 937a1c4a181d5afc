"""Quality scores from compression: which of two zstandard dictionaries suits a text better.

One dictionary is trained on texts labelled good, one on texts labelled bad. A
text is compressed with both, piece by piece; the difference of the compressed
sizes, as a share of the bytes, goes through a logistic curve fitted on labelled
texts that the dictionaries have not seen. The score is near 1 for good texts.

Fitting takes a bounded sample: at most ``per_class`` labelled rows a class
(by a hash of the id) of at most ``longest`` bytes, read whole. Scoring takes
every row and every byte. Null and empty texts differ by nothing and get the curve's
middle score. Rows with a null label or id, and ids labelled both good and bad, are
not used for fitting. With fewer than 20 usable rows of a class every score is
0.5. Labels, language, source and id are not inputs of a score. Repeated rows are
scored each, extra columns do not matter, and empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

PIECE = 512
LEVEL = 3


def held_out(id_col: str):
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def one_label(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """_id and _y of the rows that models may learn from; an id with both labels is left out."""
    rows = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & ~held_out("_id"))
    return rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_id IS NOT NULL AND _y = _z").select("_id", "_y")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, per_class: int, longest: int) -> dict[int, list[str]]:
    """At most ``per_class`` texts of each class, in a fixed order, of the first 4 * per_class labelled ids."""
    known = one_label(labels, id_col, label)
    order = F.xxhash64("_id")
    # ids first: at most 8 * per_class rows are broadcast, and no text is shuffled
    some = [known.filter(F.col("_y") == y).orderBy(order, "_id").limit(4 * per_class) for y in (0, 1)]
    rows = id_and_text(docs, id_col, text_col).filter(F.octet_length("_text") <= longest).join(F.broadcast(some[0].unionByName(some[1])), "_id")
    pick = lambda y: rows.filter(F.col("_y") == y).orderBy(order, "_id", "_text").limit(per_class)
    return {y: [r["_text"] for r in pick(y).select("_text").collect()] for y in (0, 1)}


class Sizes:
    """Compressed-size difference of a text, per byte."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        made = []
        for raw in (good, bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False))
        self.good, self.bad = made

    def difference(self, text: str) -> float:
        raw = text.encode("utf-8", "replace")
        if not raw:
            return 0.0
        good, bad, total = self.good.compress, self.bad.compress, 0
        for k in range(0, len(raw), PIECE):
            piece = raw[k : k + PIECE]
            total += len(bad(piece)) - len(good(piece))
        return total / len(raw)


def fit(texts: dict[int, list[str]], dict_bytes: int = 1 << 15) -> dict | None:
    """Dictionaries from every other text, the curve from the others."""
    if min(len(texts[0]), len(texts[1])) < 20:
        return None
    dicts = {}
    for y in (0, 1):
        raw = [t.encode("utf-8", "replace") for t in texts[y][::2]]
        pieces = [b[k : k + 2 * PIECE] for b in raw for k in range(0, len(b), 2 * PIECE)]
        size = min(dict_bytes, max(1024, sum(map(len, pieces)) // 8))
        try:
            dicts[y] = zstandard.train_dictionary(size, pieces).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            dicts[y] = b"".join(pieces)[-size:]
    sizes = Sizes(dicts[1], dicts[0])
    x = np.array([sizes.difference(t) for y in (0, 1) for t in texts[y][1::2]])
    y = np.array([float(y) for y in (0, 1) for _ in texts[y][1::2]])
    return {"good": dicts[1], "bad": dicts[0], "curve": _logistic(x, y)}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Slope, intercept and scale by Newton steps."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        w = w + np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1]), scale


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = 1500, longest: int = 1 << 16
) -> DataFrame:
    """One row a document: id, held_out, score, predicted (1 if the score is 0.7 or more)."""
    model = fit(labelled(docs, labels, id_col, text_col, label, per_class, longest))

    def run(batches):
        sizes = model and Sizes(model["good"], model["bad"])
        slope, middle, scale = model["curve"] if model else (0.0, 0.0, 1.0)
        for batch in batches:
            x = np.array([sizes.difference(t) if sizes else 0.0 for t in batch.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(slope * x / scale + middle, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(score)], ["_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "_id long, score double")
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
