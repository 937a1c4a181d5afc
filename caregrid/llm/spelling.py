"""Spelling variants: words one edit apart, found by a frontier of states that walks a relational trie.

The trie is a table of edges (node, child, label). Its nodes are the prefixes of words at
which words end or part, so a label may hold several letters and the tail that only one word
has is one edge, however long. A second trie holds the words reversed. A node's id is a hash of
its prefix; two prefixes with one id only add candidates, which the last step checks.

A state (word, position, node, edits) says that the word up to the position reads as the
node's prefix with so many edits. The states without an edit lie on the word's own path, which the
trie's making gives for all words at once. Round by round the frontier is joined with the edges of its nodes: a
state without an edit spends it where an edge leaves its path (a letter replaced or left out), a state with
one goes on only where the label agrees, and states that have used up their word at the node where another
word ends are neighbours. A letter put in is one left out of the other word, which finds the pair. No state enters a node that its next letter
does not leave. The rounds end when no state is left; each frontier is a written table.

A word of L letters that differs from another by one edit shares its first or its last (L - 1) / 2
letters with it, so the edit is spent in the back half only, in one of the two tries: near the root, where
a node has very many words, no state ever stands. A node has at most one edge a letter. The sides of
all joins have one row a key on the right (a node's edges in one list, a word's count), so that adaptive execution can split
a hot node. No join is a broadcast: no table here is small by nature.

Null texts have no words. A null id is read as the empty string when letters are left out. Repeated rows count
each time; other columns are left out, whatever their names; words of any length are whole. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed value: what each code point up to U+00FF becomes: letters of a word A-Z (lower-cased), a-z and U+00C0 to U+00FF, blanks for all others.
RUN = bytes(c if 97 <= c <= 122 or c >= 0xC0 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
LETTERS = 7
TIMES = 2
DROP = 31
RATIO = 10
HELD = 1 << 19


def _counted(batches):
    held: Counter = Counter()

    def run():
        return pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            begun = zlib.crc32(f"{'' if i is None else i}:".encode())
            runs = text.encode("latin-1", "replace").translate(RUN).split()  # a byte a code point; those beyond are no letters
            for word, n in Counter([r for r in runs if len(r) >= LETTERS]).items():
                word = word if word.isascii() else word.decode("latin-1").encode()
                h = zlib.crc32(word, begun)
                if h % DROP == 0:
                    word = word.decode()
                    k = h % len(word)
                    word = (word[:k] + word[k + 1 :]).encode()
                    if len(word) - word.count(b"\xc3") < LETTERS:
                        continue
                held[word] += n
        if len(held) > HELD:
            yield run()
            held.clear()
    yield run()


def _merged(rows: DataFrame) -> DataFrame:
    """``rows`` for a join by sorted shuffles at any size: rows made by explode or Arrow functions count as few, and Spark would broadcast very many of them."""
    return rows.hint("merge")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least LETTERS letters that occur TIMES times or more."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TIMES)


def first_depth(letters: int) -> int:
    """Where edits may begin: what is left of a word of ``letters`` letters before it."""
    return letters // 2  # (L - 1) / 2 rounded up


def _letter_hashes(letters: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    x = (letters.astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def _prefixes(batches):
    """way, k1, k2 (the word), depth, node, next (the letter that follows, empty at the end) for each prefix deep enough.

    A node's hash is the sum of hashes of its letters at their places, so sums along all words at once give all prefixes.
    """
    top = first_depth(LETTERS)
    for batch in batches:
        words = batch.column(0).to_pylist()
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        kinds, kind = np.unique(flat, return_inverse=True)
        letters = pa.array([*map(chr, kinds.tolist()), ""], pa.string())
        begin, rows = np.cumsum(n) - n, np.maximum(n + 1 - top, 0)
        place = np.arange(len(flat)) - np.repeat(begin, n)
        word = np.repeat(np.arange(len(words)), rows)
        depth = top + np.arange(len(word)) - np.repeat(np.cumsum(rows) - rows, rows)
        at, ends = begin[word] + depth, depth == n[word]
        keys = [np.array([xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words], np.uint64).view(np.int64)[word] for seed in (1, 2)]
        for way in (0, 1):
            read = np.arange(len(flat)) if way == 0 else np.repeat(begin + n - 1, n) - place
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letter_hashes(flat[read], place, 3 + way), dtype=np.uint64)])
            then = np.append(kind[read], len(kinds))[np.where(ends, len(flat), at)]
            after = pa.DictionaryArray.from_arrays(pa.array(then.astype(np.int32)), letters).cast(pa.string())
            columns = [np.full(len(word), way, np.int32), *keys, depth.astype(np.int32), (sums[at] - sums[begin[word]]).view(np.int64)]
            yield pa.record_batch([*map(pa.array, columns), after], ["way", "k1", "k2", "depth", "node", "next"])


def paths(words: DataFrame) -> DataFrame:
    """(way, letters, path): for each word and way the nodes of its own path, as (depth, node), from the top down.

    ``letters`` is the word as the way reads it. The top node of a word is its prefix of ``first_depth(LETTERS)`` letters.
    """
    every = words.select("word").mapInArrow(_prefixes, "way int, k1 long, k2 long, depth int, node long, next string")
    # words end or part here; partial aggregates: a prefix that very many words share sends a row a task
    nodes = every.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("z"), F.min("depth").alias("d"))
    nodes = nodes.filter((F.col("a") != F.col("z")) | (F.col("a") == "") | (F.col("d") == first_depth(LETTERS))).select("node")
    own = every.select("way", "k1", "k2", "depth", "node").join(_merged(nodes), "node").groupBy("k1", "k2", "way").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    named = words.select("word").mapInArrow(_named, "word string, k1 long, k2 long")
    letters = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    return named.join(_merged(own), ["k1", "k2"]).select("way", letters.alias("letters"), "path")


def _named(batches):
    for batch in batches:
        words = batch.column(0).to_pylist()
        keys = [pa.array(np.array([xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words], np.uint64).view(np.int64)) for seed in (1, 2)]
        yield pa.record_batch([batch.column(0), *keys], ["word", "k1", "k2"])


def edge_lists(own: DataFrame) -> DataFrame:
    """(node, steps): what leaves each node: an edge as (label, child), or the word that ends there as near.

    An edge's ``ahead`` has the first letters of what leaves its child, and a full stop if a word ends there.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("z"))))
    steps = own.select("letters", pair.alias("_s"))
    label = F.expr("substring(letters, _s.a.depth + 1, _s.z.depth - _s.a.depth)")  # null past the last node
    steps = steps.select(F.col("_s.a.node").alias("node"), label.alias("label"), F.col("_s.z.node").alias("child"), F.when(F.col("_s.z").isNull(), F.col("letters")).alias("near"))
    steps = written(steps.distinct(), "steps")
    first = F.when(F.col("near").isNotNull(), ".").otherwise(F.expr("substring(label, 1, 1)"))
    ahead = steps.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(first), "").alias("ahead"))
    edges = steps.filter("near IS NULL").join(_merged(ahead), "child")
    every = edges.unionByName(steps.filter("near IS NOT NULL").withColumn("ahead", F.lit("")))
    then = F.when(F.length("label") > 1, F.expr("substring(label, 2, 1)")).otherwise(F.col("ahead"))
    return every.groupBy("node").agg(F.collect_list(F.struct("label", "child", "ahead", "near", first.alias("first"), then.alias("then"))).alias("steps"))


def _may_go() -> Column:
    """Whether an edge's first letters allow any move of ``_moves``."""
    spent, first = F.col("edits") == 1, F.col("_e.first")
    replaced = (first > F.col("_c")) & (F.col("_c") != "") & F.contains(F.col("_e.then"), F.col("_d"))
    return F.when(F.col("_e.near").isNotNull(), F.length("letters") - F.col("pos") + F.col("edits") == 1).when(spent, first == F.col("_c")).otherwise(replaced | ((first == F.col("_d")) & (first != F.col("_c"))))


def _moves() -> Column:
    """The states and neighbours that one step of the trie makes of a state, as (pos, node, near); without those that end.

    Of two words of one length the one with the smaller letter finds the other, and of two lengths the longer one.
    """
    k, left = F.length("_e.label"), F.length("letters") - F.col("pos")
    own = lambda skip, n="length(_e.label)": F.expr(f"substring(letters, pos + 1 + {skip}, {n})")
    off = F.col("edits") == 0

    def to(ok: Column, skip: int) -> Column:
        then = F.expr(f"substring(letters, pos + 1 + length(_e.label) + {skip}, 1)")
        ok = ok & F.contains(F.col("_e.ahead"), F.when(then == "", ".").otherwise(then))
        return F.when(ok, F.struct((F.col("pos") + k + skip).alias("pos"), F.col("_e.child").alias("node"), F.lit(None).cast("string").alias("near")))

    end = F.col("_e.near").isNotNull() & (left + F.col("edits") == 1)
    every = F.array(
        to((F.col("edits") == 1) & (F.col("_e.label") == own(0)), 0),
        to(off & (left > 0) & (F.expr("substring(_e.label, 1, 1)") > own(0, "1")) & (F.expr("substring(_e.label, 2)") == own(1, "length(_e.label) - 1")), 0),  # replaced
        to(off & (F.expr("substring(_e.label, 1, 1)") != own(0, "1")) & (F.col("_e.label") == own(1)), 1),  # left out
        F.when(end, F.struct(F.col("pos"), F.lit(None).cast("long").alias("node"), F.col("_e.near").alias("near"))),
    )
    return F.filter(every, lambda x: x.isNotNull())


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of ``words`` (different ones) that are one inserted, deleted or replaced letter apart, both ways round."""
    own = written(paths(words), "paths")
    trie = written(edge_lists(own), "trie")
    held = F.explode(F.filter("path", lambda p: p["depth"] >= F.floor(F.length("letters") / 2)))
    now = own.select("way", "letters", held.alias("_p")).select("way", "letters", F.col("_p.depth").alias("pos"), F.col("_p.node").alias("node"), F.lit(0).alias("edits"))
    found = None
    while True:
        # the next two letters of the state rule out most edges
        two = F.expr("substring(letters, pos + 1, 1)").alias("_c"), F.expr("if(length(letters) > pos + 1, substring(letters, pos + 2, 1), '.')").alias("_d")
        met = now.join(_merged(trie), "node").select("way", "letters", "pos", "edits", *two, F.explode("steps").alias("_e")).filter(_may_go())
        met = written(met.select("way", "letters", F.explode(_moves()).alias("_m")).select("way", "letters", "_m.*"), "frontier")
        near = met.filter("near IS NOT NULL").select("way", "letters", "near")
        found = near if found is None else found.unionByName(near)
        now = met.filter("node IS NOT NULL").select("way", "letters", "pos", "node", F.lit(1).alias("edits"))
        if now.isEmpty():
            break
    read = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = found.filter(F.levenshtein("letters", "near", 1) == 1).select(read("letters").alias("word"), read("near").alias("near")).distinct()
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word: word, form (its near word of largest n, if that is RATIO times its own), root (the end of its forms), n, n_near, form_n."""
    words = written(word_counts(docs, id_col, text_col), "words")
    pairs = neighbours(words)
    counted = pairs.join(_merged(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_n"), F.col("near"))).alias("_b"))
    told = words.join(_merged(best), "word", "left").withColumn("_ok", -F.col("_b._n") >= RATIO * F.col("n"))
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_ok"), F.col("_b.near")).alias("form"), F.when(F.col("_ok"), -F.col("_b._n")).alias("form_n"))
    told = written(told, "forms")
    # counts grow tenfold at each form, so there are few forms in a row, and each round doubles how many are followed
    roots = told.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = written(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        if roots.join(_merged(onward), "root", "left_semi").isEmpty():
            break
        roots = roots.join(_merged(onward), "root", "left").select("word", F.coalesce("_to", "root").alias("root"))
    return told.join(_merged(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
