"""The dealt methods against plain Python, and the limits of memory, partitions and folders."""

import math
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import zstandard
from caregrid.llm import bpe, common, compress_quality, exact_dedup, line_dedup, line_rules, packing, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_every_code_point():
    """Ids of all code points equal those of the tokenizers library, unassigned ones too."""
    tok, ours = Tokenizer.from_file(WORD), bpe.WordBpe(WORD)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c % 97 == 0)]
    texts = ["".join(f"a{c} {c}1 " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for k in range(0, len(texts), 256):
        want = tok.encode_batch(texts[k : k + 256], add_special_tokens=False)
        assert [x.tolist() for x in ours.ids(texts[k : k + 256])] == [e.ids for e in want]


def test_kept_chunks_are_bounded():
    """Long chunks are never kept, others up to a number of bytes; ids stay right."""
    kept, tok = words.TokenizerIds(BYTE), Tokenizer.from_file(BYTE)
    kept.most = 20_000
    for k in range(40):
        texts = [f"tab\t{k} nbsp {k} " + "x" * 5000 + f" word{k}a word{k}b\r\n end", f"no{k}blank" * 200]
        assert [x.tolist() for x in kept.ids(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert kept.held <= kept.most and max(map(len, kept.place)) <= kept.longest and len(kept.flat) <= 1 << 18


def test_groups_in_few_tasks(spark, monkeypatch):
    """More groups than tasks: every piece is packed once; columns with the names used inside go along."""
    monkeypatch.setattr(packing, "MOST_TASKS", 3)
    rows = [(k, 1 + k * 37 % 90, k, k, k, -1) for k in range(400)]
    pieces = spark.createDataFrame(rows, "`a b` long, length long, n long, row long, seq long, sequence_id long")
    got = packing.pack(pieces, capacity=100, group=32)
    assert got.columns == ["a b", "length", "n", "row", "seq", "sequence_id", "offset"]
    bins = {}
    for r in got.collect():
        assert r["n"] == r["row"] == r["seq"] == r["a b"]
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, bins.values())) == 400
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 100


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)


def test_equal_digests_of_different_texts(spark):
    """Texts that share a digest are told apart by their whole content."""
    rows = [(1, "ab"), (2, "AB"), (3, "cd"), (4, "cd"), (5, "xyz"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for digest in (exact_dedup.SHA256, lambda t: F.length(t).cast("string")):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, digest=digest).collect()}
        assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (7, 2, False), 7: (7, 2, True)}


def test_compression_scores(spark):
    """Scores from the definition: dictionaries of every other text, sizes of pieces, the curve's formula."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = compress_quality.fit(compress_quality.labelled(docs, labels, "doc_id", "text", "quality", 1500, 1 << 16))
    both = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(model[k]), write_content_size=False, write_checksum=False) for k in ("good", "bad")]
    slope, middle, scale = model["curve"]
    got = {r.doc_id: r for r in compress_quality.scores(docs, labels).collect()}
    for r in docs.filter("doc_id % 10 = 0").collect():
        raw = (r.text or "").encode()
        good, bad = (sum(len(c.compress(raw[k : k + 512])) for k in range(0, len(raw), 512)) for c in both)
        want = 1 / (1 + math.exp(-(slope * (bad - good) / max(len(raw), 1) / scale + middle)))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_conflicting_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (3, 1), (5, None), (None, 1), (8, 7)], "doc_id long, quality int")
    assert [tuple(r) for r in compress_quality.one_label(labels, "doc_id", "quality").collect() if r._id in (1, 3, 5, 8, None)] in ([(3, 1)], [])


def test_suffix_array(spark):
    """Deleted lines are those of later copies in the intervals of a sorted suffix array with its common prefixes."""
    rng = np.random.default_rng(4)
    lines = ["a b c", "d", "e f", "", "g h i j"]
    docs = [(i, "\n".join(rng.choice(lines, rng.integers(1, 12)))) for i in range(25)]
    least, split = 6, [t.split("\n") for _, t in docs]
    suffixes = sorted((x[p:], d, p) for d, x in enumerate(split) for p in range(len(x)))
    lcp = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:]):
        lcp.append(next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))
    gone = {d: set() for d, _ in docs}
    for m in range(1, max(lcp) + 1):  # intervals with a common prefix of m lines
        runs, now = [], [suffixes[0]]
        for s, shared in zip(suffixes[1:], lcp[1:]):
            if shared >= m:
                now.append(s)
            else:
                runs.append(now)
                now = [s]
        for run in [*runs, now]:
            if len(run) > 1 and sum(len(x.split()) for x in run[0][0][:m]) >= least:
                for _, d, p in sorted(run, key=lambda s: s[1:])[1:]:
                    gone[d] |= set(range(p, p + m))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r.removed) for r in line_dedup.line_dedup(frame, min_words=least, removed_col="removed").collect()}
    assert got == {d: ("\n".join(x for k, x in enumerate(split[d]) if k not in gone[d]), len(gone[d])) for d, _ in docs}


def test_removed_lines(spark):
    """The number of lines that went, where a blank line, or nothing, is left; a column of that name is replaced."""
    run = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, run, 9), (2, f"{run}\n", 9), (3, run, 9), (4, None, 9)], "doc_id long, text string, gone int")
    got = line_dedup.line_dedup(docs, removed_col="gone")
    assert got.columns == ["doc_id", "text", "gone"]
    assert sorted((r.doc_id, r.text if r.doc_id != 1 else "", r.gone) for r in got.collect()) == [(1, "", 0), (2, "", 1), (3, "", 1), (4, None, 0)]


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    """The same result whether groups are hot or not."""
    rng = np.random.default_rng(7)
    docs = [(i, "\n".join(rng.choice(["a b", "c d e", "f"], rng.integers(1, 9)))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(line_dedup, "HOT", 1)
    cold = {r.doc_id: r.text for r in line_dedup.line_dedup(frame, min_words=5).collect()}
    monkeypatch.setattr(line_dedup, "HOT", 1 << 40)
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(frame, min_words=5).collect()} == cold


def test_line_labels(spark):
    """Labels are the best of all sequences, vary within texts, and decide what is kept; notices in kept texts are marked."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = line_rules.chains(docs).collect()
    model = line_rules.train(line_rules.chains(docs), labels)
    got = {r.doc_id: r for r in line_rules.line_rules(docs, labels).collect()}
    assert sum(0 < r.content_share < 1 for r in got.values()) > 20
    for r in rows:
        x, n = line_rules.features(bytes(r.own), r.lines, r.flags), np.array(r.words)
        if 1 <= len(x) <= 10:
            u = x @ model["w"]
            score = lambda y: sum(u[i, k] for i, k in enumerate(y)) + sum(model["trans"][a, b] for a, b in zip(y, y[1:]))
            best = max(product((1, 0), repeat=len(x)), key=score)
            assert [k for k, y in enumerate(best) if y == 0] == got[r._id].boilerplate
            share = sum(w for w, y in zip(n, best) if y) / n.sum()
            assert abs(got[r._id].content_share - share) < 1e-12 and got[r._id].kept == (not got[r._id].base_failed and share >= 0.5)
    texts = {r.doc_id: [x for x in r.text.split("\n") if common.WORD_RE.search(x)] for r in docs.collect()}
    marked = [texts[k][i] for k, r in got.items() if r.kept for i in r.boilerplate]
    notices = [x for k, r in got.items() if r.kept for x in texts[k] if "licen" in x.lower()]
    assert notices and sum("licen" in x.lower() for x in marked) >= 0.9 * len(notices)


def test_recurring_lines(spark):
    """A line of three texts with other neighbours recurs; lines of copies only do not open or close."""
    texts = [f"{a}\nnotice\n{b}" for a, b in ("ab", "cd", "ef")] + ["ab\ncopied\nlines"] * 4 + ["ab\ncopied\nlines\nmore", "x\nab\ncopied\nlines"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r._id: r for r in line_rules.chains(docs).collect()}
    told = {k: {tuple(f) for f in r.flags or []} for k, r in rows.items()}
    assert all(told[k] == {(rows[k].lines[1], True, True)} for k in range(3))
    assert all((h, False, False) in told[3] for h in rows[3].lines[1:2]) and len(told[3]) == 3
