"""Spelling variants, phrase collocations and the Jaccard join against plain versions, small bounds and odd inputs."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from caregrid.llm import collocations, jaccard, registry, signature_tree, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variants_of(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = defaultdict(set)
    holes = defaultdict(set)  # words with a letter left out
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add((w, k))
    for w in n:
        for other, _ in holes.get(w, ()):
            near[w].add(other)
            near[other].add(w)
    for group in holes.values():
        for w, k in group:
            near[w] |= {v for v, j in group if v != w and j == k and len(v) == len(w)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def told(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_variants_of_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = variants_of(rows)
    assert sum(v[3] > 0 for v in want.values()) > 100
    assert told(registry.op11_spelling(spark, SF)) == want


def test_variants_planted(spark):
    """Every kind and place of edit, chains of forms, ties, prefixes of others, very long words, letters beyond ASCII."""
    rng = np.random.default_rng(7)
    words = ["abcdefgh", "bcdefgh", "xabcdefgh", "abcdefg", "abcdefghi", "abcdefgx", "xbcdefgh", "abcxdefgh", "abcefgh", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "éabcdefg", "abcdéefgh", "Àbcdefgh", "ÀBCDEFGH"]
    for size in (7, 8, 9, 30, 3000):
        w = "".join(rng.choice(list("abé"), size))
        words += [w, w[1:], w[:-1], w + "a", "b" + w, "z" + w[1:], w[:-1] + "z", w[: size // 2] + "q" + w[size // 2 :], w[: size // 2] + w[size // 2 + 1 :]]
    docs = [(k, " ".join([w] * int(rng.choice([2, 3, 25, 300, 4000 if len(w) < 100 else 40]))), "x") for k, w in enumerate(words)]
    docs += [(200 + n, " ".join(["zzyyxxv" + "w" * k] * n), "x") for k, n in enumerate([2, 30, 400, 5000])]  # forms in a row
    docs += [(None, "nullid1 nullidx nullidx1", "x"), (77, None, "x"), (78, "", "x"), (79, "short a b", "x")] + [(80, "repeated rowwwws", "x")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, word string")
    want = variants_of([r[:2] for r in docs])
    assert max(v[3] for v in want.values()) >= 3 and any(v[0] and v[1] != v[0] and want[v[0]][1] != want[v[0]][0] for v in want.values())
    assert told(spelling.variants(df)) == want


def test_variants_of_nothing(spark, empty):
    assert spelling.variants(empty).collect() == []


def collocations_of(rows, least, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in cand.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(v for p, v in own.items() if len(p) == 1)
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n, -s)
    return out


@pytest.mark.parametrize("room", [collocations.ROOM, (64, 200, 60)])
def test_collocations_planted(spark, room):
    """Small words so that all cuts, overlaps, ties and dropped phrases occur; small bounds so that tries burst and spill."""
    rng = np.random.default_rng(3)
    letters = list("abcdeé")
    docs = [(str(rng.choice(["en", "und", "fr"])), " ".join(rng.choice(letters + ["a", "a", "a.", "B", "c,\nd", "x\ty"], 300)), 1) for _ in range(60)]
    docs += [(None, "a a a a a a a a a a a a", 1), ("en", None, 1), (None, None, 1), ("en", "", 1), ("de", "...", 1), ("es", "x y z " * 20, 1)] + [("en", "same row", 1)] * 12
    df = spark.createDataFrame(docs, "lang string, text string, w1 int").repartition(5)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, least=6, top=40, room=room).collect()}
    assert got == collocations_of([r[:2] for r in docs], 6, 40)


def test_trie_bursts_and_spills():
    rng = np.random.default_rng(5)
    trie, want = collocations.HatTrie(2, burst=100), Counter()
    for _ in range(30):
        packed = (rng.zipf(1.5, 500) % 2000).astype(np.int64) << 21 | rng.integers(0, 2000, 500)
        trie.add(packed)
        want.update(packed.tolist())
    assert len(trie.boxes) > 3 and len(trie) == len(want)
    got = Counter()
    for to in (len(want) // 2, 0):
        for keys, counts in trie.spill(to):
            got.update(dict(zip(keys.tolist(), counts.tolist())))
        assert len(trie) <= to
    assert got == want


def test_collocations_of_nothing(spark, empty):
    assert collocations.collocations(empty).collect() == []


def set_of(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(rows):
    """By all pairs of different sets that share a shingle."""
    sets = list({set_of(t) for _, t in rows} - {frozenset()})
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    post = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            post[x].append(k)
    for k, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in post[x] if j > k).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(j)] = find(k)
    place = {s: find(k) for k, s in enumerate(sets)}
    least = {}
    for i, t in rows:
        if (s := set_of(t)) and i is not None:
            least[place[s]] = min(i, least.get(place[s], i))
    return Counter((i, len(s := set_of(t)), least.get(place[s]) if s else i) for i, t in rows)


def test_jaccard_of_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF.replace('0.001', '0.01')}/documents.parquet'").fetchall()
    want = components_of(rows)
    got = registry.op12_jaccard(spark, SF.replace("0.001", "0.01"))
    assert Counter(map(tuple, got.collect())) == want


def family(rng, words, n, changes, copies):
    """A text and copies of it with some words replaced, near the least similarity."""
    base = rng.choice(words, n)
    out = [" ".join(base)]
    for _ in range(copies):
        w = base.copy()
        w[rng.choice(n, int(rng.integers(0, changes + 1)), replace=False)] = rng.choice(words, 1)
        out.append(" ".join(w))
    return out


def test_jaccard_planted(spark, monkeypatch):
    """Families near the bound, common passages, chains, small files and files dealt into blocks."""
    rng = np.random.default_rng(11)
    words = np.array([f"w{k}" for k in range(4000)])
    passage = " ".join(rng.choice(words, 60))
    texts = [t for _ in range(12) for t in family(rng, words, int(rng.integers(5, 400)), 12, 8)]
    texts += [passage + " " + " ".join(rng.choice(words, int(rng.integers(5, 40)))) for _ in range(120)]  # share most of their text
    chain = list(rng.choice(words, 200))
    texts += [" ".join(chain[k : k + 150]) for k in range(0, 50, 3)]
    texts += ["a b", "A B", "a", "one two three four five", "one two three four five six", None, "", " \n\t", passage, passage]
    docs = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x"), (None, "only null ids have this text", "x"), (3, texts[3], "x"), (3, texts[3], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, node string").repartition(4)
    want = components_of([r[:2] for r in docs])
    assert Counter(map(tuple, jaccard.jaccard_join(df).collect())) == want
    monkeypatch.setattr(signature_tree, "HOT", 16)
    assert Counter(map(tuple, jaccard.jaccard_join(df).collect())) == want


def test_trees_lose_no_pair():
    """The dual walk leaves no pair that links, and far fewer than all; maps of one and of two widths."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(150):
        base = rng.integers(0, 1 << 63, int(rng.integers(40, 130)), np.int64).astype(np.uint64)
        for _ in range(3):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 1 << 63, 3).astype(np.uint64)])))
    signs = [signature_tree.signature(s) for s in sets]
    n, over = np.array([len(s) for s in sets]), np.array([k for _, k in signs])
    ids = np.arange(len(sets))
    for side in (np.full(len(sets), 2), ids % 2):
        a, b = signature_tree.file_pairs(ids, n, over, [x for x, _ in signs], ids, side, 80)
        got = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
        assert len(got) == len(a) < 0.1 * len(sets) ** 2
        want = {frozenset((i, j)) for i in ids for j in range(i) if (side[i] == 2 or side[i] != side[j]) and 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (n[i] + n[j])}
        assert len(want) > 50 and want <= got


def test_jaccard_of_nothing(spark, empty):
    assert jaccard.jaccard_join(empty).collect() == []
