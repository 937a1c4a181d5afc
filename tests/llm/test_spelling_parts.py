"""op11's word scan and prefixes against plain loops; both are made for many letters at once."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from caregrid.llm import spelling


def test_words_by_translation():
    assert isinstance(spelling.RUN, bytes)  # no regular expression a word
    rng = random.Random(1)
    letters = "abcdeABCZz éÀ×÷ÿĀſKİ\x85\xa0¿\x1c.0\n\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    ids = [None if k % 9 == 0 else str(k) for k in range(60)]
    want = Counter()
    for i, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{i or ''}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                want[word] += 1
    got = Counter()
    for batch in spelling._counted([pa.record_batch([pa.array(ids, pa.string()), pa.array(texts)], ["i", "t"])]):
        for row in batch.to_pylist():
            got[row["word"]] += row["n"]
    assert got == want and len(want) > 100


def test_prefixes_of_all_words():
    words = ["abcdefg", "abcdefgh", "xbcdefg", "étéétéé", "aaaaaaaaaa", "b" * 5000]
    rows = [r for b in spelling._prefixes([pa.record_batch([pa.array(words)], ["word"])]) for r in b.to_pylist()]
    names = {r["k1"]: w for w, r in zip(words, sorted({(r["k1"], r["k2"]): r for r in rows}.values(), key=lambda r: rows.index(r)))}
    nodes = {}
    for r in rows:
        word = names[r["k1"]] if r["way"] == 0 else names[r["k1"]][::-1]
        assert r["next"] == word[r["depth"] : r["depth"] + 1]
        nodes.setdefault(r["node"], set()).add((r["way"], word[: r["depth"]]))
    assert all(len(x) == 1 for x in nodes.values())
    assert len(nodes) == len({(way, w[::step][:d]) for w in words for way, step in ((0, 1), (1, -1)) for d in range(3, len(w) + 1)})
    assert len(rows) == sum(2 * (len(w) - 2) for w in words)


def test_nothing_is_broadcast(spark, monkeypatch):
    """Spark takes rows made by explode or Arrow functions for few; at any estimate joins are by shuffles."""
    plans, real = [], spelling.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "written", lambda df, name: plans.append(plan(df)) or real(df, name))
    rows = [(k, "hospital " * 30 + "hospitel hospitel") for k in range(4)]
    found = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum("SortMergeJoin" in p for p in [*plans, plan(found)]) >= 5
    assert not any("Broadcast" in p for p in [*plans, plan(found)])
    assert {r.word: r.form for r in found.collect()}["hospitel"] == "hospital"
