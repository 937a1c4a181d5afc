"""Phrase collocations: n-grams counted in HAT-tries, level by level, scored by their weakest cut.

Each task counts the n-grams of its own texts in a HAT-trie: the root leads from a
language and a first word to a container, a hash table from the packed ids of the
words to a count. Containers are burstable: one that grows beyond ROOM[0] entries
gives its largest first words containers of their own. When a task's tries hold
ROOM[1] entries, their largest subtrees leave it whole, each as a run sorted by word id, until
half the room is free. Runs of all tasks are merged where Spark's shuffle brings
them together: by the language and all words of the phrase, so that a prefix that a
third of the rows share is spread by what follows it.

A phrase is frequent only if its parts are, so words are counted first, then pairs of
frequent words, then triples of two frequent pairs. Tasks learn what is frequent from
a bit map of fixed size (BITS); a false hit costs a count that is dropped later, and
counts never depend on it. All counts and products are exact.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs
into words, whole and of any length. A null text is empty; a null language is ``und`` and one with
rows of that name. Ids are not used: null ids and repeated rows count like others. Other columns are left
out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, written

LEAST = 10
TOP = 2000
#: Entries of a container before it bursts and of a trie before it spills, and a task's own word ids (at most 2 ** 21).
ROOM = (1 << 16, 1 << 20, 1 << 19)
BITS = 27
RUN = "lang string, phrase string, n long"
#: What ends a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_CUT = bytes.maketrans(ENDS, b"." * len(ENDS))
_SHIFT = 21


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of the texts in order; a full stop stands between pieces."""
    flat = b".".join(texts).lower().translate(_CUT)
    return flat.replace(b".", b" . ").split()


class HatTrie:
    """Counts packed sequences of word ids; the id of the first word is in the highest bits of ``width`` ids."""

    def __init__(self, width: int, burst: int) -> None:
        self.down, self.burst = _SHIFT * (width - 1), burst
        self.clear()

    def clear(self) -> None:
        self.boxes = [Counter()]
        self.child = np.zeros(1 << 10, np.int32)  # first word -> container; 0 is the one that words share
        self.full = self.burst  # when it bursts next

    def __len__(self) -> int:
        return sum(map(len, self.boxes))

    def add(self, packed: np.ndarray) -> None:
        if not len(packed):
            return
        first = packed >> self.down
        if (top := int(first.max())) >= len(self.child):
            self.child = np.concatenate([self.child, np.zeros(max(len(self.child), top + 1 - len(self.child)), np.int32)])
        box = self.child[first]
        order = np.argsort(box, kind="stable")
        where, start = np.unique(box[order], return_index=True)
        for k, part in zip(where.tolist(), np.split(packed[order], start[1:])):
            self.boxes[k].update(part.tolist())
        if len(self.boxes[0]) > self.full:
            self._burst()

    def _burst(self) -> None:
        """The first words that fill the shared container most get containers of their own."""
        shared = self.boxes[0]
        keys = np.fromiter(shared, np.int64, len(shared))
        words, n = np.unique(keys >> self.down, return_counts=True)
        own = words[n >= max(2, self.burst >> 6)]
        self.child[own] = np.arange(len(self.boxes), len(self.boxes) + len(own))
        self.boxes += [Counter() for _ in own]
        for key, box in zip(keys.tolist(), self.child[keys >> self.down].tolist()):
            if box:
                self.boxes[box][key] = shared.pop(key)
        self.full = max(self.burst, 2 * len(shared))  # what stays may be many rare words

    def spill(self, to: int = 0):
        """Whole subtrees, the largest first, as (keys, counts) until ``to`` entries are left."""
        held = len(self)
        for k in sorted(range(len(self.boxes)), key=lambda k: -len(self.boxes[k])):
            box = self.boxes[k]
            if held <= to or not box:
                break
            held -= len(box)
            yield np.fromiter(box.keys(), np.int64, len(box)), np.fromiter(box.values(), np.int64, len(box))
            self.boxes[k] = Counter()


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def _mix(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of hashes of words (uint64); that of one word is itself."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h
    return out


def _hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


class _Words:
    """A task's word ids of one language; only words that may be frequent have one."""

    def __init__(self, lang: str, bits: np.ndarray) -> None:
        self.lang, self.bits = lang, bits
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {b".": -1}
        self.words: list[bytes] = []
        self.hashes = np.zeros(1 << 12, np.uint64)

    def ids(self, toks: list[bytes]) -> np.ndarray:
        """-1 for the end of a piece and for words that are not frequent."""
        got = np.fromiter(map(self.place.get, toks, repeat(-2)), np.int64, len(toks))
        miss = np.flatnonzero(got == -2).tolist()
        if miss:
            new = list(dict.fromkeys(toks[k] for k in miss))
            h = np.fromiter((_word_hash(self.lang, w) for w in new), np.uint64, len(new))
            for w, hit, x in zip(new, _hit(self.bits, h).tolist(), h):
                if hit:
                    if len(self.words) == len(self.hashes):
                        self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
                    self.hashes[len(self.words)] = x
                    self.place[w] = len(self.words)
                    self.words.append(w)
                else:
                    self.place[w] = -1
            got[miss] = [self.place[toks[k]] for k in miss]
        return got


def _rows(lang: str, words: pa.Array, keys: np.ndarray, counts: np.ndarray, width: int) -> pa.RecordBatch:
    """A run, sorted by word ids: lang, phrase, n."""
    order = np.argsort(keys)
    keys = keys[order]
    parts = [words.take(pa.array(keys >> (_SHIFT * (width - 1 - k)) & ((1 << _SHIFT) - 1))) for k in range(width)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
    return pa.record_batch([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int64))), phrase.cast(pa.string()), pa.array(counts[order])], ["lang", "phrase", "n"])


def _by_lang(batch: pa.RecordBatch):
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, own in texts.items():
        for a, z in by_bytes(own):
            yield lang, own[a:z]


def _word_runs(batches):
    """Counts of all words; the empty word has the number of words of its language."""
    held: dict[str, Counter] = {}

    def run(lang):
        box = held.pop(lang)
        box[b""] = sum(box.values())
        words = sorted(box)
        return pa.record_batch([pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([box[w] for w in words], pa.int64())], ["lang", "phrase", "n"])

    for batch in batches:
        for lang, texts in _by_lang(batch):
            box = held.setdefault(lang, Counter())
            box.update(tokens(texts))
            del box[b"."]
            if len(box) > ROOM[1] >> 1:
                yield run(lang)
    for lang in list(held):
        yield run(lang)


def _gram_runs(batches, width: int, singles: np.ndarray, pairs: np.ndarray | None, room: tuple[int, int, int]):
    """Runs of the n-grams of ``width`` words whose words, and pairs of words if given, may be frequent."""
    tries: dict[str, tuple[_Words, HatTrie]] = {}

    def runs(lang, to=0):
        known, trie = tries[lang]
        words = pa.array(known.words, pa.binary())
        for keys, counts in trie.spill(to):
            for a in range(0, len(keys), room[0]):  # runs of bounded size
                yield _rows(lang, words, keys[a : a + room[0]], counts[a : a + room[0]], width)

    for batch in batches:
        for lang, texts in _by_lang(batch):
            known, trie = tries.setdefault(lang, (_Words(lang, singles), HatTrie(width, room[0])))
            ids = known.ids(tokens(texts))
            cols = [ids[k : len(ids) - width + 1 + k] for k in range(width)] if len(ids) >= width else [ids[:0]] * width
            ok = np.logical_and.reduce([c >= 0 for c in cols])
            cols = [c[ok] for c in cols]
            if pairs is not None and len(cols[0]):
                h = [known.hashes[c] for c in cols]
                ok = np.logical_and.reduce([_hit(pairs, _mix([a, b])) for a, b in zip(h, h[1:])])
                cols = [c[ok] for c in cols]
            packed = cols[0]
            for c in cols[1:]:
                packed = packed << _SHIFT | c
            trie.add(packed)
            if len(known.place) > room[2]:  # ids run out: all leaves
                yield from runs(lang)
                known.clear()
                trie.clear()
            elif sum(len(t) for _, t in tries.values()) > room[1]:
                for other in tries:
                    yield from runs(other, len(tries[other][1]) // 2)
    for lang in tries:
        yield from runs(lang)


def _bit_map(frequent: DataFrame, width: int) -> Broadcast:
    """A map of 2 ** BITS bits with those set of the frequent n-grams; the driver gets at most that much."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            rows = [p.split(b" ") for p in batch.column(1).cast(pa.binary()).to_pylist()]
            h = _mix([np.fromiter((_word_hash(x, w[k]) for x, w in zip(langs, rows)), np.uint64, len(langs)) for k in range(width)])
            at = (h >> np.uint64(64 - BITS)).astype(np.int64)
            yield pa.record_batch([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["at", "bit"])

    set_ = frequent.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << BITS >> 6, np.int64)
    out[set_.column("at").to_numpy()] = set_.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, room: tuple[int, int, int] = ROOM) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all n-grams of 1 to 3 words that occur ``least`` times or more, and (lang, n), all words counted."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = written(rows.mapInArrow(_word_runs, RUN).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == "")), "words")
    levels = [every.filter("phrase <> ''")]
    words, pairs = _bit_map(levels[0], 1), None
    for width in (2, 3):

        def run(batches, width=width, words=words, pairs=pairs):
            return _gram_runs(batches, width, words.value, pairs and pairs.value, room)

        counts = rows.mapInArrow(run, RUN).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        levels.append(written(counts.filter(F.col("f") >= least), f"grams{width}"))
        if width == 2:
            pairs = _bit_map(levels[1], 2)
    told = [x.select("lang", F.lit(k + 1).alias("k"), "phrase", "f") for k, x in enumerate(levels)]
    return told[0].unionByName(told[1]).unionByName(told[2]), every.filter("phrase = ''").select("lang", F.col("f").alias("n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    a, left, right = (x.cast("decimal(16,0)") for x in (a, left, right))
    return F.call_function("div", (a * a).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)"), (left * right).cast("decimal(32,0)"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, room: tuple[int, int, int] = ROOM) -> DataFrame:
    """Each language's first ``top`` phrases of 2 or 3 words: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, lang_col, text_col, least, room)
    word = F.split("phrase", " ")
    told = counts.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), word.alias("_w"), "k")
    join = lambda a, z: F.array_join(F.slice("_w", a, z), " ")
    part = lambda cut, side, text: F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), text.alias("part"))
    two = F.array(part(1, "l", join(1, 1)), part(1, "r", join(2, 1)))
    three = F.array(part(1, "l", join(1, 1)), part(1, "r", join(2, 2)), part(2, "l", join(1, 2)), part(2, "r", join(3, 1)))
    asked = told.select("lang", "phrase", "a", F.explode(F.when(F.col("k") == 2, two).otherwise(three)).alias("_p")).select("lang", "phrase", "a", "_p.*")
    found = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cuts = found.groupBy("lang", "phrase", "a", "cut").agg(side("l").alias("l"), side("r").alias("r"))
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_m")).select("lang", "phrase", "a", "_m.l", "_m.r", "_m.score")
    inside = told.filter("k = 3").select("lang", F.explode(F.array_distinct(F.array(join(1, 2), join(2, 2)))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter("_longer IS NULL OR 100 * _longer < 50 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the limit is applied in each task before the rows of a language meet
    first = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
