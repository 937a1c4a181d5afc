"""Quality rules by line labelling: a linear-chain CRF marks each line content or boilerplate.

Counts of a text (words, word characters, symbols, repeated lines, words in
repeated three-word windows) decide the base rules. The lines of a text form a
chain; Viterbi decoding over line features and label transitions finds the most
likely labels, and a text is kept if the base rules pass and at least
``share`` of its words lie in content lines.

Features of a line come from its own text, its place, and the corpus: whether
at least ``RECURS`` different texts hold it and it follows, or comes before, many
different lines there. Notices, signatures and footers do. That a line recurs is no
sign by itself: the lines of near copies have like neighbours wherever they stand. Neighbours
are told apart by their longest word, which few edits of a copy change.

The field is fitted here by gradient ascent on its conditional likelihood, on a
bounded sample: at most ``per_class`` labelled texts a class of at most
``longest`` characters in words and ``most_lines`` lines, read whole. Only texts have labels,
so the labels of lines are learnt in turns: first the lines of bad texts and the
recurring lines with many neighbours are boilerplate; then the field is fitted,
Viterbi decoding gives new line labels, and the field is fitted again.
A text whose decoded content share contradicts its own label keeps the labels it had.
With fewer than 20 texts of a class all lines are content.

Null and empty texts have no words and fail the base rule. Long texts are taken
whole. Texts that repeat count once in the corpus features; repeated rows are
repeated in the result, extra columns are left out, empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, keyed_rows, written
from .compress_quality import one_label

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
LEAST_WORDS = 50

OWN = 9  # features from the line's own text
SEEN = 2  # features from the corpus
FEATURES = OWN + SEEN
RECURS = 3
SALTS = 16
TURNS = 3
LOSS = 2.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray, list[str], list[str]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); of each line with a word: own features, words, the line, its longest word."""
    lines = text.split("\n")
    words = [WORD_RE.findall(x) for x in lines]
    n = np.fromiter(map(len, words), np.int64, len(words))
    total = int(n.sum())
    repeated = _in_repeated_windows([w for row in words for w in row])
    at = np.concatenate([[0], np.cumsum(n)])
    seen: set[str] = set()
    dup, rows = 0, []
    for k, (line, own) in enumerate(zip(lines, words)):
        again = line in seen
        seen.add(line)
        if not own:
            continue
        dup += again
        m = len(own)
        symbols = sum(map(line.count, SYMBOLS))
        rows.append(
            (
                1.0,
                min(symbols / m, 1.0),
                sum(map(str.isupper, own)) / m,
                min(line.count("!") / m, 1.0),
                repeated[at[k] : at[k + 1]].mean(),
                float(again),
                1.0 - len(set(own)) / m,
                float(m < 4),
                float(line.rstrip(BLANKS).endswith((".", "?", ":"))),
            )
        )
    chars = len(text) - sum(map(text.count, BLANKS))
    counts = (total, chars, sum(map(text.count, SYMBOLS)), dup, int(repeated.sum()))
    return counts, np.array(rows, np.float32).reshape(-1, OWN), n[n > 0], [x for x, own in zip(lines, words) if own], [max(own, key=len) for own in words if own]


def _in_repeated_windows(words: list[str]) -> np.ndarray:
    """Whether each word lies in a three-word window that the text holds twice or more."""
    out = np.zeros(len(words), bool)
    if len(words) < 4:
        return out
    ids: dict[str, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    k = len(ids)
    pair = np.unique(x[:-1] * k + x[1:], return_inverse=True)[1]  # small again, so that triples fit 64 bits
    _, which, n = np.unique(pair[:-1] * k + x[2:], return_inverse=True, return_counts=True)
    hit = n[which] > 1
    for shift in range(3):
        out[shift : len(out) - 2 + shift] |= hit
    return out


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: _id, _k1, _k2 (the document), mark (its text), counts, words, own (float32), lines and heads (hashes of the line and of its longest word) of its lines with words."""

    def run(batches):
        for batch in filter(len, batches):
            rows = [measure(t) for t in batch.column(4).to_pylist()]
            counts = [pa.array(c, pa.int64()) for c in zip(*(r[0] for r in rows))]
            words = pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))
            own = pa.array([r[1].tobytes() for r in rows], pa.binary())
            hashed = lambda k: pa.array([np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in r[k]], np.uint64).view(np.int64) for r in rows], pa.list_(pa.int64()))  # noqa: E731, B023
            yield pa.record_batch([*(batch.column(k) for k in range(4)), *counts, words, own, hashed(3), hashed(4)], names)

    names = ["_id", "_k1", "_k2", "mark", *COUNTS, "words", "own", "lines", "heads"]
    schema = "_id long, _k1 long, _k2 long, mark long, " + ", ".join(f"{c} long" for c in COUNTS) + ", words array<int>, own binary, lines array<long>, heads array<long>"
    rows = keyed_rows(docs, id_col, text_col).select("_id", "_k1", "_k2", F.xxhash64(F.lit(2), "_text").alias("mark"), "_text")
    return rows.mapInArrow(run, schema)


def recurring(rows: DataFrame) -> DataFrame:
    """mark, flags: for each different text with recurring lines, their hashes with whether many different lines come before or after."""
    before = F.concat(F.array(F.lit(0).cast("long")), "heads")
    after = F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.lit(0).cast("long")))
    own = rows.filter(F.size("lines") > 0).select("mark", F.inline(F.arrays_zip(F.col("lines").alias("h"), F.slice(before, 1, F.size("lines")).alias("prev"), after.alias("next"))))
    often = own.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= RECURS).select("h")
    shared = written(_salted(own, often).select("mark", "h", "prev", "next"), "shared")
    # which texts, lines before and lines after: different ones, counted in two steps
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("mark", "prev", "next"))])
    different = shared.select("h", F.inline(kinds)).distinct()
    n = different.groupBy("h").agg(*[F.count_if(F.col("kind") == k).alias(c) for k, c in enumerate(("texts", "befores", "afters"))])
    many = lambda c: (F.col(c) >= RECURS) & (2 * F.col(c) >= F.col("texts"))
    told = n.filter(F.col("texts") >= RECURS).select("h", many("befores").alias("opens"), many("afters").alias("closes"))
    held = _salted(shared.select("mark", "h").distinct(), told)
    return held.groupBy("mark").agg(F.collect_list(F.struct("h", "opens", "closes")).alias("flags"))  # bounded by the text


def _salted(rows: DataFrame, one_each: DataFrame, key: str = "h") -> DataFrame:
    """``rows`` joined with ``one_each`` (one row a key); a hot key's rows go to SALTS tasks."""
    salt = F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")
    spread = one_each.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(spread, [key, "_salt"])


def chains(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measured`` rows with flags, in a written table."""
    rows = written(measured(docs, id_col, text_col), "measured")
    flags = recurring(rows).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("_k1", "_id"), F.lit(SALTS)).cast("int")  # a text may repeat in very many rows
    return written(rows.withColumn("_salt", salt).join(flags, ["mark", "_salt"], "left").drop("_salt", "heads"), "chains")


def features(own: bytes, lines: list[int], flags: list | None) -> np.ndarray:
    """Lines x FEATURES: the line's own, then whether many different lines come before or after it."""
    x = np.frombuffer(own, np.float32).reshape(-1, OWN)
    seen = np.zeros((len(x), SEEN), np.float32)
    if flags:
        told = {f["h"]: (f["opens"], f["closes"]) for f in flags}
        for k, h in enumerate(lines):
            if h in told:
                seen[k] = told[h]
    return np.hstack([x, seen]).astype(np.float64)


def viterbi(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Most likely labels of a chain; unary: lines x 2, trans: from x to. Ties go to label 1."""
    best, back = unary[0], []
    for u in unary[1:]:
        via = best[:, None] + trans
        prev = np.where(via[1] >= via[0], 1, 0)
        back.append(prev)
        best = via[prev, (0, 1)] + u
    label = int(best[1] >= best[0])
    out = [label]
    for prev in reversed(back):
        label = int(prev[label])
        out.append(label)
    return np.array(out[::-1])


def fit_crf(xs: list[np.ndarray], ys: list[np.ndarray], weights: np.ndarray, start: dict | None = None, steps: int = 120, ridge: float = 1.0) -> dict:
    """Weights of a two-label chain from the labels of lines, label 1 being content; each chain counts with its weight."""
    order = np.argsort([-len(x) for x in xs], kind="stable")
    xs, ys, weights = [xs[i] for i in order], [ys[i] for i in order], np.asarray(weights, float)[order]
    lengths = np.array([len(x) for x in xs])
    # lines by place: chains fall in length, so those that have a place are the first ones
    live = [int((lengths > t).sum()) for t in range(lengths[0])]
    x = [np.array([xs[i][t] for i in range(n)]) for t, n in enumerate(live)]
    y = [np.array([ys[i][t] for i in range(n)]) for t, n in enumerate(live)]
    w, trans = (start["w"].copy(), start["trans"].copy()) if start else (np.zeros((xs[0].shape[1], 2)), np.zeros((2, 2)))
    gw, gt = np.zeros_like(w), np.zeros_like(trans)
    for _ in range(steps):
        u = [part @ w for part in x]
        fore, z = [u[0]], np.logaddexp(u[0][:, 0], u[0][:, 1])
        for t in range(1, len(live)):
            last = fore[-1][: live[t]]
            fore.append(np.logaddexp(last[:, :1] + trans[0], last[:, 1:] + trans[1]) + u[t])
            z[: live[t]] = np.logaddexp(fore[t][:, 0], fore[t][:, 1])
        dw, dt, back = -ridge * w, -ridge * trans, np.zeros((len(xs), 2))
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            rows = np.arange(n)
            err = -np.exp(fore[t] + back[:n] - z[:n, None])
            err[rows, y[t]] += 1
            dw = dw + x[t].T @ (err * weights[:n, None])
            if t:
                ahead = back[:n] + u[t]
                joint = -np.exp(fore[t - 1][:n, :, None] + trans + ahead[:, None, :] - z[:n, None, None])
                joint[rows, y[t - 1][:n], y[t]] += 1
                dt = dt + (joint * weights[:n, None, None]).sum(axis=0)
                back[:n] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
        gw, gt = gw + dw**2, gt + dt**2  # per-weight step sizes
        w, trans = w + 0.5 * dw / np.sqrt(gw + 1e-9), trans + 0.5 * dt / np.sqrt(gt + 1e-9)
    return {"w": w, "trans": trans}


def learn(xs: list[np.ndarray], words: list[np.ndarray], labels: list[int], share: float = 0.5) -> dict:
    """The field from texts with one label each: lines are labelled, and the field fitted, in turns."""
    # to begin with: a recurring line with many neighbours on a side is boilerplate, and so is all of a bad text
    now = [np.where((x[:, OWN:] > 0).any(axis=1), 0, y).astype(int) for x, y in zip(xs, labels)]
    # a good text that is lost weighs more than a bad one that stays
    weights = np.where(np.array(labels) == 1, LOSS, 1.0)
    model = fit_crf(xs, now, weights)
    for _ in range(TURNS - 1):
        for k, (x, n, y) in enumerate(zip(xs, words, labels)):
            path = viterbi(x @ model["w"], model["trans"])
            if (n[path == 1].sum() >= share * n.sum()) == bool(y):
                now[k] = path
        model = fit_crf(xs, now, weights, model, steps=60)
    return model


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 600, longest: int = 1 << 15, most_lines: int = 256, label_id: str = "doc_id") -> dict | None:
    """The field from ``chains`` rows of labelled texts; None with too few of a class."""
    order = F.xxhash64("_id")
    known = one_label(labels, label_id, label)
    some = [known.filter(F.col("_y") == y).orderBy(order, "_id").limit(4 * per_class) for y in (0, 1)]
    fit = rows.filter((F.col("word_chars") <= longest) & F.size("lines").between(1, most_lines)).join(F.broadcast(some[0].unionByName(some[1])), "_id")
    xs, words, ys = [], [], []
    for y in (0, 1):
        for r in fit.filter(F.col("_y") == y).orderBy(order, "_id", "mark").limit(per_class).select("own", "lines", "flags", "words").collect():
            xs.append(features(bytes(r["own"]), r["lines"], r["flags"]))
            words.append(np.array(r["words"]))
            ys.append(y)
    if min(ys.count(0), ys.count(1)) < 20:
        return None
    return learn(xs, words, ys)


def content_share(path: np.ndarray, words: np.ndarray) -> float:
    return float(words[path == 1].sum() / words.sum()) if len(words) else 0.0


def line_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5) -> DataFrame:
    """One row a document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, boilerplate (lines with words, from 0), kept."""
    rows = _verdicts(docs, labels, id_col, text_col, share)
    return rows.select(F.col("_id").alias(id_col), *COUNTS, "base_failed", "content_share", "boilerplate", "kept")


def _verdicts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, share: float) -> DataFrame:
    rows = chains(docs, id_col, text_col)
    model = train(rows, labels, label_id=id_col)

    def run(batches):
        for batch in batches:
            shares, marked = [], []
            for own, lines, flags, words in zip(*(batch.column(k).to_pylist() for k in range(8, 12))):
                x, n = features(own, lines, flags), np.array(words, np.int64)
                path = viterbi(x @ model["w"], model["trans"]) if model and len(x) else np.ones(len(x), int)
                shares.append(content_share(path, n))
                marked.append(np.flatnonzero(path == 0).astype(np.int32))
            yield pa.record_batch([*(batch.column(k) for k in range(8)), pa.array(shares, pa.float64()), pa.array(marked, pa.list_(pa.int32()))], names)

    names = ["_id", "_k1", "_k2", *COUNTS, "content_share", "boilerplate"]
    schema = ", ".join(f"{n} long" for n in names[:8]) + ", content_share double, boilerplate array<int>"
    told = rows.select(*names[:8], "own", "lines", "flags", "words").mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return told.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= share))


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules keep; rows that agree in id and text share a verdict."""
    told = _verdicts(docs, labels, id_col, text_col, share).filter("kept").select("_k1", "_k2").distinct()
    return keyed_rows(docs, id_col, text_col).join(told, ["_k1", "_k2"], "left_semi").select("_row.*")
