"""Operators against plain Python on small inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from caregrid.llm import bpe, id_files, jaccard, kd_shards, line_dedup, line_rules, packing, registry, sanitise, simhash, similar, words
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_exact_dedup(spark):
    assert_same(spark, registry.op10_exact_dedup, registry.OP10_SQL, SF)


def fp(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in registry.op1_simhash(spark, SF).collect()}
    fps = {k: fp(t) for k, t in texts.items()}
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{fps[k]:016x}", find(k)) for k in fps}


def test_simhash_hot_files(spark, monkeypatch):
    """Many fingerprints around one: files beyond HOT are filed again, and no link is lost."""
    monkeypatch.setattr(simhash, "HOT", 16)
    rng = random.Random(1)
    fps = {rng.getrandbits(64)}
    while len(fps) < 400:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    rows = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(rows).collect()}
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)

    def classes(pairs):
        root = {x: x for x in fps}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for x in fps:
            out[find(x)].add(x)
        return sorted(map(sorted, out.values()))

    assert classes(links) == classes((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3)


def test_keep_one_of_each_component(spark):
    """Null and repeated ids: a component never goes because another has its id."""
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, c), (9, d), (9, d), (3, a.upper())]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", a.upper()), ("None", b), ("7", c), ("7", d)])


def test_near_duplicates_of_the_pipeline(spark, monkeypatch):
    """All pairs at five-word similarity 0.8 or more are found, and only these; files of several blocks too."""
    import corpus_pipeline

    monkeypatch.setattr(similar, "SHINGLES", 500)
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for k in range(40):
        texts.append([word() for _ in range(rng.choice([4, 30, 100, 120]))])
        for _ in range(12 if k == 0 else rng.randint(0, 2)):
            copy = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    linked = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {k for k in root if find(k) == k}
    assert len(linked) > 20 and sum((fp(rows[a][1]) ^ fp(rows[b][1])).bit_count() > 3 for a, b in linked) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want


def test_near_duplicates_of_a_table(spark):
    """By min-hashes the stage finds what the exact join finds on a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = jaccard.jaccard_join(docs).collect()
    empty = [r.doc_id for r in exact if not r.n_shingles]
    want = {r.component_id for r in exact if r.n_shingles} | {min(empty)} if empty else {r.component_id for r in exact}
    assert sum(r.component_id != r.doc_id for r in exact) > 50
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == want


def test_line_dedup(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["a b c", "d", "e f", "", "g h i j"]) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    lines = [t.split("\n") for _, t in docs]
    for least in (5, 9):
        want = {}
        for d, x in enumerate(lines):
            gone = set()
            for i in range(len(x)):
                best = 0
                for e in range(d + 1):
                    for j in range(len(lines[e]) if e < d else i):
                        n = 0
                        while i + n < len(x) and j + n < len(lines[e]) and x[i + n] == lines[e][j + n]:
                            n += 1
                        best = max(best, n)
                if sum(len(WORDS.findall(z)) for z in x[i : i + best]) >= least:
                    gone |= set(range(i, i + best))
            want[d] = "\n".join(z for k, z in enumerate(x) if k not in gone)
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        assert {r.doc_id: r.text for r in line_dedup.line_dedup(frame, min_words=least).collect()} == want


def test_kd_shards(spark, texts):
    rows = registry.op3_kd_shards(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(24)) and max(size.values()) <= sum(size.values()) / 24 + max(r["size"] for r in rows)


def test_id_files(spark, texts):
    tok = Tokenizer.from_file(BYTE)
    at, want = 0, {}
    for k in sorted(texts):
        ids = np.array([*tok.encode(texts[k], add_special_tokens=False).ids, 0], "<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.op5_id_files(spark, SF).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**32 - 1)), max_size=3000))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (id_files.decode_blocks(id_files.encode_blocks(ids), id_files.bit_sizes(ids)) == ids).all()


def test_damaged_block():
    ids = np.arange(3000, dtype=np.uint32)
    blocks = id_files.encode_blocks(ids)
    n, crc, data = blocks[1]
    blocks[1] = (n, crc, bytes([data[0] ^ 1]) + data[1:])
    with pytest.raises(ValueError):
        id_files.decode_blocks(blocks, id_files.bit_sizes(ids))


TEXT = st.text(st.sampled_from("ab éÉ\n\t'stΣ1²!|<>日́  the on"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ids_equal_the_tokenizers(texts):
    for path, kinds in ((WORD, (bpe.WordBpe, words.TokenizerIds)), (BYTE, (words.TokenizerIds,))):
        want = [e.ids for e in _TOK[path].encode_batch(texts, add_special_tokens=False)]
        for kind in kinds:
            assert [x.tolist() for x in words.worker_ids(kind, path).ids(texts)] == want


_TOK = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def test_bpe(spark, texts):
    tok = _TOK[WORD]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in registry.op9_bpe(spark, SF).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_packing(spark, texts):
    rows, bins = registry.op8_best_two_fit(spark, SF).collect(), defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for k, t in texts.items():
        ids = np.array([*_TOK[WORD].encode(t, add_special_tokens=False).ids, 1], "<u4")
        want = [(i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[k]) == want
    total = 0
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 4096
        total += at
    assert len(bins) <= -(-total // 4096) + 2


def test_two_fit_beats_greedy():
    where, offset, fill = packing.best_two_fit([60, 30, 25, 14], 100)  # greedy: 60 + 30, 25 + 14; two-fit: 60 + 25 + 14
    assert fill.max() == 99 and where.max() == 1


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    found = [(m.start(), rank, m.end(), k) for rank, (k, p) in enumerate(PII.items()) for m in re.finditer(p, text) if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark):
    rng = random.Random(5)
    odd = ["a@b.c_d@e.f é x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 1", "9" * 5000, "a." * 3000 + "@x.y", "x@" + "a." * 5000 + "b", "1 " * 6000, "😀 4111111111111111 é@x.fr"]
    odd += ["".join(rng.choice(alphabet) for _ in range(70)) for alphabet in ("ab@.1 2+-()é4", "0123456789 -.+") for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    for r in rows.select("text", sanitise.written_spans(sanitise.base_spans(rows.text)).alias("x")).collect():
        assert r.x == base(r.text)


def test_telling_terms(spark):
    """A word that only ever stands by an entity goes, a common one stays, and other documents are not touched."""
    near = [(i, f"the quarterly note {i} names zebrafinch near ann@x.org and more words follow {i}") for i in range(6)]
    far = [(100 + i, f"the quarterly note {i} has nothing else but more words follow here") for i in range(60)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitise.sanitised(docs).collect()}
    assert all("zebrafinch" not in got[i] and "[EMAIL]" in got[i] and "quarterly" in got[i] and "words follow" in got[i] for i, _ in near)
    assert all(got[i] == t for i, t in far)


def forms(kind, value):
    """An entity, its groups and its kind, from the finest."""
    value, d = value.lower(), re.sub("[^0-9]", "", value)
    if kind == "email":
        host = value.rsplit("@", 1)[1]
        own = [value, "@" + host, "@." + host.rsplit(".", 1)[1]]
    elif kind == "ip":
        own = [value, *(".".join(value.split(".")[:n]) for n in (3, 2, 1))]
    else:
        own = [d, *(d[:n] for n in (6, 4, 2, 1))]
    return [(kind, k, x) for k, x in enumerate([*own, ""])]


def shares(texts, support=3):
    """Entities of each text and the disclosure of each (entity, term), by plain Python; spans and terms of each text."""
    spans = {k: [(int(a), kind, int(b)) for x in base(t).split(",") if x for kind, a, b in [x.split(":")]] for k, t in texts.items()}
    clear = {k: "".join(" " if any(a <= i < b for a, _, b in spans[k]) else c for i, c in enumerate(t)) for k, t in texts.items()}
    words = {k: [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t)] for k, t in clear.items()}
    holds = defaultdict(set)
    for k in texts:
        for a, kind, b in spans[k]:
            for f in forms(kind, texts[k][a:b]):
                holds[f].add(texts[k])
    own, by_entity, by_term = defaultdict(set), defaultdict(set), defaultdict(set)
    for k in texts:
        for a, kind, b in spans[k]:
            e = next((f for f in forms(kind, texts[k][a:b]) if len(holds[f]) >= support), None)
            if e:
                own[k].add(e)
                by_entity[e].add(k)
        for _, _, w in words[k]:
            by_term[w].add(k)
    out = {}
    for e, ks in by_entity.items():
        for w in {w for k in ks for _, _, w in words[k]}:
            both = ks & by_term[w]
            if len({texts[k] for k in both}) >= support:
                out[e, w] = 1 - np.log(len(by_term[w]) / len(both)) / max(np.log(len(texts) / len(ks)), 1e-9)
    return own, out, spans, words


def term_spans(texts, generalise_at=0.8, remove_at=0.95, **how):
    own, share, spans, words = shares(texts, **how)
    out = {}
    for k in texts:
        most = lambda w: max((share.get((e, w), 0) for e in own[k]), default=0)
        more = [(a, "remove" if most(w) >= remove_at else "generalise", b) for a, b, w in words[k] if most(w) >= generalise_at]
        out[k] = sorted(spans[k] + more, key=lambda s: (s[0], sanitise.KINDS.index(s[1])))
    return out


def told(texts, **how):
    """Sanitised texts by plain Python: counts of whole documents, all occurrences of telling terms."""
    out = {}
    for k, found in term_spans(texts, **how).items():
        at, text = 0, ""
        for a, kind, b in found:
            if a >= at:
                text += texts[k][at:a] + sanitise.TAGS[kind]
            at = max(at, b)
        out[k] = text + texts[k][at:]
    return out


def test_term_spans_of_the_tables(spark):
    """All spans and all disclosures of whole tables, against plain Python; both tags at lower thresholds."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    want = {k: ",".join(f"{kind}:{a}:{b}" for a, kind, b in v) for k, v in term_spans(texts).items()}
    assert {r.doc_id: r.spans for r in registry.op6_sanitise(spark, sf).collect()} == want
    keyed = sanitise._keyed(rows.selectExpr("doc_id AS _id", "coalesce(text, '') AS _text"))
    held = keyed.withColumn("base", sanitise.base_spans(F.col("_text")))
    got = {(r.entity, r.term): r.disclosure for r in sanitise.disclosures(keyed, held)[1].collect()}
    share = {(f"{list(PII).index(e[0])}:{e[1]}:{e[2]}", w): x for (e, w), x in shares(texts)[1].items()}
    assert got.keys() == share.keys() and all(abs(got[k] - share[k]) < 1e-9 for k in got)
    low = {"generalise_at": 0.25, "remove_at": 0.4}  # few terms tell much in so small a table
    want = {k: ",".join(f"{kind}:{a}:{b}" for a, kind, b in v) for k, v in term_spans(texts, **low).items()}
    assert {r.doc_id: r.x for r in sanitise.find_spans(rows, **low).select("doc_id", sanitise.written_spans(F.col("spans")).alias("x")).collect()} == want
    assert all(any(f"{kind}:" in x for x in want.values()) for kind in ("generalise", "remove"))


def test_long_texts_with_many_matches(spark):
    """Positions and replacement over many matches, overlapping ones too."""
    text = "".join(f"é{k} a{k}@b.co 10.0.0.{k % 300} 1.2.3.4_4111111111111111@x.org\n" for k in range(150))
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = row.select(sanitise.written_spans(sanitise.base_spans(row.text)).alias("x"), sanitise._blanked(row.text, sanitise.base_spans(row.text)).alias("y")).first()
    spans = [tuple(map(int, x.split(":")[1:])) for x in base(text).split(",")]
    chars = list(text)
    for a, b in spans:
        chars[a:b] = " " * (b - a)
    assert got.x == base(text) and got.y == "".join(chars)
    assert sanitise.sanitised(row).first().text == told({1: text})[1]


def test_telling_terms_of_whole_documents(spark):
    """A term counts, and goes, wherever it stands in a document of the entity, once or again."""
    fill = "plain filler words of the report go on and on " * 8
    texts = {i: f"{fill}{i} quokka far off. zebrafinch by ann@x.org {i} {fill} \u0130zmir again zebrafinch {fill}" for i in range(6)}
    texts |= {50 + i: f"{fill} {i} nothing else" for i in range(60)} | {200: f"{fill} quokka alone"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitise.sanitised(docs).collect()}
    assert all("zebrafinch" not in got[i] and "quokka" not in got[i] and "filler" in got[i] for i in range(6)) and "quokka" in got[200]
    assert {k: t for k, t in got.items() if k >= 50} == {k: t for k, t in texts.items() if k >= 50}
    assert {k: t for k, t in told({k: t.replace("\u0130", "i") for k, t in texts.items()}).items()} == {k: t.replace("\u0130", "i") for k, t in got.items()}


def test_telling_terms_at_the_ends(spark):
    """The first and the last word of a text are terms like all others."""
    texts = {i: f"{w}: marlowe@x.org wrote number {i}{end}" for i, (w, end) in enumerate([("Marlowe", "\nsigned Ferdinand"), ("marlowe", " Ferdinand\n")] * 3)}
    texts |= {50 + i: f"number {i} has wrote and signed nothing else" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitise.sanitised(docs).collect()}
    assert not any(w in got[i].lower() for i in range(6) for w in ("marlowe", "ferdinand")) and got == told(texts)


def test_line_counts(spark, texts):
    for r in registry.op7_line_rules(spark, SF).collect():
        t = texts[r.doc_id]
        w = WORDS.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(WORDS.search(line)) and line in seen
            seen.add(line)
        n = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) for k in range(3) if n[tuple(w[i : i + 3])] > 1}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(30):
        u, t = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
        score = lambda y: sum(u[i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))
        best = max(([i >> k & 1 for k in range(5)] for i in range(32)), key=score)
        assert line_rules.viterbi(u, t).tolist() == best


@pytest.mark.parametrize("name", ["op4_compress_quality", "op7_line_rules"])
def test_labels_are_learnt(spark, name):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.queries()[name](spark, sf).collect() if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    if name == "op4_compress_quality":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        assert np.mean([r.predicted == label[r.doc_id] for r in rows]) > 0.85
    else:
        rows = [r for r in rows if not r.base_failed]
        assert np.mean([r.kept == bool(label[r.doc_id]) for r in rows]) > 0.95


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        docs = out
    want = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want
