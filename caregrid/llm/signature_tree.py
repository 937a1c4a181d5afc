"""Links between sets that share a key, by signature trees.

A set's signature is a bit map of its tokens (at least sixteen bits a token, up to MOST bits, packed by zstandard: nearly all bits
are zero), its size and how many tokens found their bit taken. Sets that share a key form a file, and pairs are
sought within files only. A pair may link only if its possible overlap, the bits that
both maps have plus the tokens without a bit of their own, is large enough.

Files of up to SMALL sets are searched by counts alone: of their pairs, summed over all these files, those go on that share enough keys. Of two
sets, take the one whose keys end first in the common order: tokens among its keys that the other has are shared keys, so the overlap is at most the number of
shared keys and the tokens past its keys. A row of a pair is smaller than a signature, and most pairs fall there. Larger files' sets
are each tied to one of them. Of these pairs each set's with the one it shares most keys with is compared exactly;
then those that are still apart, both if their signatures allow a link. Linked sets form classes. Most files are then in one class and done.
In the others that are not small trees are searched, without the sets that sizes and numbers of keys keep from all others of the file: the sets of a file lie in order of size; FAN of them make
a node, FAN nodes one above, and each node holds the OR of the maps below it, their range of sizes and the largest number of
tokens without a bit. Two trees are walked together from the top; a pair of nodes is left as soon as its
ranges or its greatest possible overlap exclude every pair below it, or when all below is in one class.
Trees hold the maps folded FOLD times, since OR-combined wide maps say no more; pairs left at the bottom are held against the whole maps.
What is left then is compared exactly, the best pairs first: a search gives a spanning forest of a file's classes, made of the pairs with the
greatest possible overlap, so no more pairs than rows. Files that had further pairs are searched again with the classes found by then, and all pairs that are
still apart are compared. Files with equal members count as one.

A file of more than HOT sets is searched in blocks: classes of size (a pair never lies
more than one apart) cut by a hash of the class of linked sets; a task holds two blocks.
No key is held in one place before that: files are counted and compared by partial sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holds, written
from .components import components

MOST = 1 << 18
SPARE = 16
FOLD = 4
FAN = 8
SMALL = 128
HOT = 2048


def bit_map(hashes: np.ndarray) -> np.ndarray:
    """The set's tokens by their low bits, as uint64 words; the number of bits is a power of two."""
    bits = 256
    while bits < min(SPARE * len(hashes), MOST):
        bits *= 2
    out = np.zeros(bits >> 6, np.uint64)
    at = hashes & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def signature(hashes: np.ndarray) -> tuple[bytes, int]:
    """The map, packed, and the number of tokens without a bit of their own."""
    bits = bit_map(hashes)
    return zstandard.ZstdCompressor(1).compress(bits.tobytes()), len(hashes) - int(np.bitwise_count(bits).sum())


def unpacked(bits: list[bytes]) -> list[np.ndarray]:
    """The maps of signatures."""
    tool = zstandard.ZstdDecompressor()
    return [np.frombuffer(tool.decompress(b), np.uint64) for b in bits]


def folded(bits: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of maps with fewer words (a token's bit is the low bits of its hash), and the tokens without a bit of their own then."""
    bits = np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)
    return bits, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def overlap(bits_a, bits_b, hi_a, hi_b, over_a, over_b) -> np.ndarray:
    """The greatest possible overlap."""
    most = np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64) + np.minimum(over_a, over_b)
    return np.minimum(most, np.minimum(hi_a, hi_b))


def possible(bits_a, bits_b, n_a, n_b, over_a, over_b, percent: int) -> np.ndarray:
    """Whether the greatest possible overlap allows a link; for nodes n is (least, most) of the sizes below."""
    (lo_a, hi_a), (lo_b, hi_b) = n_a, n_b
    return (100 + percent) * overlap(bits_a, bits_b, hi_a, hi_b, over_a, over_b) >= percent * (lo_a + lo_b)


class Tree:
    """Levels of nodes over sets in order of size: maps, ranges of sizes, tokens without a bit, ranges of classes."""

    def __init__(self, n: np.ndarray, over: np.ndarray, bits: np.ndarray, root: np.ndarray) -> None:
        self.order = np.argsort(n, kind="stable")
        n, root = n[self.order], root[self.order]
        self.levels = [(bits[self.order], n, n, over[self.order], root, root)]
        while len(self.levels[-1][1]) > 1:
            bits, lo, hi, over, first, last = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(over, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes of a level, and each one's place in ``nodes``."""
        kids = nodes[:, None] * FAN + np.arange(FAN)
        ok = kids < len(self.levels[level - 1][1])
        return kids[ok], np.nonzero(ok)[0]


def _allowed(x: Tree, y: Tree, level_x: int, level_y: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    (bits_x, *x), (bits_y, *y) = x.levels[level_x], y.levels[level_y]
    lo_x, hi_x, over_x, first_x, last_x = (v[a] for v in x)
    lo_y, hi_y, over_y, first_y, last_y = (v[b] for v in y)
    ok = (100 * hi_x >= percent * lo_y) & (100 * hi_y >= percent * lo_x)
    ok &= ~((first_x == last_x) & (first_y == last_y) & (first_x == first_y))
    at = np.flatnonzero(ok)
    step = max(1, (1 << 22) // bits_x.shape[1])  # 32 MB of maps at once
    for s in range(0, len(at), step):
        k = at[s : s + step]
        ok[k] = possible(bits_x[a[k]], bits_y[b[k]], (lo_x[k], hi_x[k]), (lo_y[k], hi_y[k]), over_x[k], over_y[k], percent)
    return ok


def walk(x: Tree, y: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets of both trees that may link; each pair once if the trees are one."""
    same, i, j = x is y, len(x.levels) - 1, len(y.levels) - 1
    a = b = np.zeros(1, np.int64)
    while len(a) and (i or j):
        down_x, down_y = i >= j, j >= i  # the taller tree goes down alone until both are level
        if down_x:
            kids, at = x.below(i, a)
            a, b, i = kids, b[at], i - 1
        if down_y:
            kids, at = y.below(j, b)
            a, b, j = a[at], kids, j - 1
        if same:
            a, b = a[a <= b], b[a <= b]
        ok = _allowed(x, y, i, j, a, b, percent)
        a, b = a[ok], b[ok]
    if same:
        a, b = a[a < b], b[a < b]
    return x.order[a], y.order[b]


def placed_pairs(n: np.ndarray, over: np.ndarray, bits: list[bytes], root: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places of a file's sets that may link and are in different classes, and their greatest possible similarity.

    side: 0 and 1 are two blocks, whose own pairs are not sought; 2 is a whole file.
    """
    maps = unpacked(bits)
    width = np.array([len(m) for m in maps])
    parts = [(w, at, np.stack([maps[k] for k in at.tolist()]), s) for w in np.unique(width).tolist() for s in np.unique(side).tolist() if len(at := np.flatnonzero((width == w) & (side == s)))]
    del maps

    def tree(words: int, at: np.ndarray, whole: np.ndarray) -> Tree:
        low, lost = folded(whole, n[at], words // FOLD)
        return Tree(n[at], lost, low, root[at])

    trees = [tree(w, at, whole) for w, at, whole, _ in parts]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for (w, at, whole, s), one in zip(parts, trees):
        for (v, other, more, t), two in zip(parts, trees):
            if v not in (w, 2 * w) or (s == t < 2) or (v == w and s > t):
                continue  # sizes of a link are never more than a factor of two apart
            lost = over[other]
            if v > w:
                more, lost = folded(more, n[other], w)
                two = tree(w, other, more)
            a, b = walk(one, two, percent)
            keep = root[at[a]] != root[other[b]]
            a, b = a[keep], b[keep]
            step = max(1, (1 << 22) // w)
            for k in range(0, len(a), step):
                x, y = a[k : k + step], b[k : k + step]
                most, sizes = overlap(whole[x], more[y], n[at[x]], n[other[y]], over[at[x]], lost[y]), n[at[x]] + n[other[y]]
                ok = (100 + percent) * most >= percent * sizes
                out.append((at[x[ok]], other[y[ok]], most[ok] / (sizes - most)[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def file_pairs(node: np.ndarray, n: np.ndarray, over: np.ndarray, bits: list[bytes], root: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of all ``placed_pairs``."""
    a, b, _ = placed_pairs(n, over, bits, root, side, percent)
    return node[a], node[b]


def groups(batches, keys: int):
    """Runs of rows that agree in their first ``keys`` columns, each as one table; rows lie in order of these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)])
        cuts = [*(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[0].column(c)[0].as_py() != k[c, 0] for c in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for cut in cuts:
            held.append(batch.slice(start, cut - start))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            start = cut
    if held:
        yield pa.Table.from_batches(held)


def spanning(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of pairs (a, b) that make a spanning forest, the ones of highest score: each class takes its best pair, again and again."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label, live, out = np.arange(len(names)), np.argsort(-score, kind="stable"), [np.zeros(0, np.int64)]
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return np.concatenate(out)
        ends = np.stack([label[a[live]], label[b[live]]], axis=1)
        best = np.unique(np.unique(ends, return_index=True)[1] // 2)
        out.append(live[best])
        x, y = ends[best].T
        while (label[x] != label[y]).any():  # x and y are labels: their own entries lead to the merged one
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
        label = label[label]


def _searched(percent: int, best: bool):
    """Pairs (a, b) that may link; with ``best`` a forest of them, and the keys of files that have more."""

    def run(batches):
        for group in groups(batches, 3):
            node, n, over, root, side = (group.column(c).to_numpy() for c in ("node", "n", "over", "root", "side"))
            bits, more = group.column("bits").to_pylist(), False
            if best:
                a, b, score = placed_pairs(n, over, bits, root, side, percent)
                some = spanning(root[a], root[b], score)
                more, a, b = len(some) < len(a), node[a[some]], node[b[some]]
            else:
                a, b = file_pairs(node, n, over, bits, root, side, percent)
            for s in range(0, len(a), 1 << 16):
                x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], ["a", "b", "key"])
            if more:
                yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([group.column("key")[0].as_py()])], ["a", "b", "key"])

    return run


def _passing(percent: int):
    """Pairs (a, b), with their number of files c, whose signatures allow a link."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            n_a, n_b = (batch.column(c).to_numpy() for c in (3, 5))
            for k, (x, y) in enumerate(zip(*(unpacked(batch.column(c).to_pylist()) for c in (4, 6)))):
                x, y = x[None], y[None]
                words, n, m = min(x.shape[1], y.shape[1]), n_a[k : k + 1], n_b[k : k + 1]
                (x, over_x), (y, over_y) = folded(x, n, words), folded(y, m, words)
                keep[k] = possible(x, y, (n, n), (m, m), over_x, over_y, percent)[0]
            keep = pa.array(keep)
            yield pa.record_batch([batch.column(c).filter(keep) for c in range(3)], ["a", "b", "c"])

    return run


def shared(filed: DataFrame) -> DataFrame:
    """The rows of ``filed`` (key, node: long, different) of each key that two nodes or more have, with their number _n; of keys with equal nodes, one, and their number _w."""
    held = filed.groupBy("key").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y"))
    keys = held.filter("_n > 1").groupBy("_n", "_x", "_y").agg(F.min("key").alias("key"), F.count("*").alias("_w")).select("key", "_n", "_w")
    return filed.join(keys, "key")


def compared(percent: int):
    """Pairs (a, b) of rows (a, b, x, y) whose sets, as bytes of sorted hashes, link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((100 + percent) * both >= percent * (len(x) + len(y)))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by ``sets`` (node, hashes)."""
    one = lambda c, name: sets.select(F.col("node").alias(c), F.col("hashes").alias(name))
    linked = pairs.select("a", "b").join(one("a", "x"), "a").join(one("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compared(percent), "a long, b long")
    return written(linked, "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _more(links: DataFrame, pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``links`` with those of ``pairs`` (a written table) that link."""
    return links if pairs.isEmpty() else links.unionByName(exact_links(pairs, written(sets_of(_ends(pairs)), "sets"), percent))


def _signs_of(nodes: DataFrame, signs: DataFrame) -> DataFrame:
    """The signatures of ``nodes``, one row a node; most others stay where they are."""
    nodes = written(nodes, "nodes")
    return signs.filter(holds(nodes)("node")).join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _sized(percent: int) -> str:
    return f"100 * n_a >= {percent} * n_b AND 100 * n_b >= {percent} * n_a"


def _needed(percent: int) -> str:
    """The least number of shared keys of a link between sets of n_a and n_b tokens; a set has ceil(percent * n / 100) - 1 tokens past its keys."""
    overlap = f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}"
    return f"{overlap} - ({percent} * greatest(n_a, n_b) + 99) div 100 + 1"


def _counted(files: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b, c): pairs with the number of keys they share in files of at most ``most`` sets, and those of larger files' sets with the smallest of the file.

    ``files`` has _all, the number of a node's shared keys, and _large, of those in larger files. A pair of small files is left out if it can't share enough keys in all.
    """
    near, one = f"{_sized(percent)} AND least(all_a, all_b) >= {_needed(percent)}", ("node", "n", "_all", "_large")
    named = lambda rows, c, *more: rows.select("key", *more, *[F.col(x).alias(y) for x, y in zip(one, (c, f"n_{c}", f"all_{c}", f"large_{c}"))])
    small, large = files.filter(F.col("_n") <= most), files.filter(F.col("_n") > most)
    met = named(small, "a").join(named(small, "b", "_w"), "key").filter("a < b").filter(near)
    met = met.select("a", "b", "_w", F.expr(f"{_needed(percent)} - least(large_a, large_b)").alias("_least"))
    pairs = met.groupBy("a", "b").agg(F.sum("_w").alias("c"), F.max("_least").alias("_least")).filter("c >= _least").select("a", "b", "c")
    firsts = large.groupBy("key").agg(F.min(F.struct(*one)).alias("_s")).select("key", *[F.col(f"_s.{x}").alias(x) for x in one])
    tied = named(firsts, "a").join(named(large, "b", "_w"), "key").filter("a <> b").filter(near).groupBy("a", "b").agg(F.sum("_w").alias("c"))
    return pairs.unionByName(tied).groupBy("a", "b").agg(F.sum("c").alias("c"))


def _partnered(percent: int):
    """The rows of a file that may link with another one in another class, by sizes and numbers of shared keys."""

    def run(batches):
        for group in groups(batches, 1):
            n, most, root = (group.column(c).to_numpy() for c in ("n", "_all", "root"))
            past, keep = (percent * n + 99) // 100 - 1, np.zeros(len(n), bool)
            for a in range(0, len(n), 256):
                own = slice(a, a + 256)
                least = percent * (n[own, None] + n)
                ok = (100 + percent) * (np.minimum(most[own, None], most) + np.maximum(past[own, None], past)) >= least
                ok &= 100 * np.minimum(n[own, None], n) >= percent * np.maximum(n[own, None], n)
                keep[own] = (ok & (root[own, None] != root)).any(axis=1)
            for batch in group.filter(pa.array(keep)).to_batches():
                yield batch

    return run


def _rooted(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, c) whose nodes are in different classes."""
    return _rooted(_rooted(pairs, roots, "a", "_x"), roots, "b", "_y").filter("_x <> _y").select("a", "b", "c")


def mixed_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``files`` (key, node and others) that have nodes of different classes by ``roots`` (node, root)."""
    files = written(files, "files")
    classed = _rooted(files.select("key", "node"), roots, "node", "root")
    mixed = classed.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).filter("_a <> _z").select("key")
    return files.join(written(mixed, "mixed"), "key")


def tree_links(files: DataFrame, signs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, known: DataFrame | None = None) -> DataFrame:
    """(a, b): enough links to join all nodes of ``files`` that are linked within files, in a chain too.

    ``files`` has key, node, _n and _w, as ``shared`` gives them, with all keys of each node that other nodes have; ``signs`` node, n, over and bits (rows of one node are equal); ``sets_of`` takes rows with a node and
    returns them with its hashes. ``known`` (node, root: written) has classes found before: their links are part of the result, pairs in one class are not compared, and keys of one class may be missing in ``files``.
    """
    files, most = written(files, "files"), min(SMALL, HOT)
    before = None if known is None else known.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if before is not None and files.isEmpty():
        return before
    every = files.groupBy("node").agg(F.sum("_w").alias("_all"), F.sum(F.when(F.col("_n") > most, F.col("_w")).otherwise(0)).alias("_large"))
    files = written(files.join(every.join(signs.select("node", "n").dropDuplicates(["node"]), "node"), "node"), "weighed")
    star = written(_counted(files, percent, most), "stars")
    if known is not None:
        star = written(_apart(star, known), "apart")
    own = written(_signs_of(_ends(star), signs), "signs")
    one = lambda c: own.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def allowed(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "c", "n_a", "bits_a", "n_b", "bits_b")
        return written(both.mapInArrow(_passing(percent), "a long, b long, c long"), name)

    # each set with the one it shares most keys with: its own hashes travel once, those of the other once for all
    closest = written(star.groupBy("b").agg(F.max_by(F.struct("a", "c"), F.struct("c", "a")).alias("_m")).select("_m.a", "b", "_m.c"), "closest")
    near = allowed(closest, "near")
    asked = _ends(near).join(near.select(F.col("b").alias("node"), "a"), "node", "left")
    sets = written(sets_of(asked), "sets")
    both = sets.filter("a IS NOT NULL").select("a", F.col("node").alias("b"), F.col("hashes").alias("x")).join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("y")), "a")
    links = written(both.select("a", "b", "x", "y").mapInArrow(compared(percent), "a long, b long"), "links")
    links = links if before is None else before.unionByName(links)
    roots = written(components(links), "roots")
    # then what is still apart
    rest = star.join(closest, ["a", "b"], "left_anti")
    apart = written(_apart(rest, roots), "apart")
    links = _more(links, allowed(apart, "pairs"), sets_of, percent)
    files = files.filter(F.col("_n") > most)
    if files.isEmpty():
        return links
    found = _search(files, signs, links, percent, True)
    pairs = written(found.filter("key IS NULL").select("a", "b").distinct(), "pairs")
    links = _more(links, pairs, sets_of, percent)
    again = files.join(found.filter("key IS NOT NULL").select("key").distinct(), "key")
    if again.isEmpty():
        return links
    rest = _search(again, signs, links, percent, False).select("a", "b").distinct()
    return _more(links, written(rest.join(pairs, ["a", "b"], "left_anti"), "pairs"), sets_of, percent)


def _search(files: DataFrame, signs: DataFrame, links: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b, key) as ``_searched`` gives them, of files with sets in different classes by ``links``."""
    classed = written(_rooted(files.select("key", "node", "_n", "n", "_all"), components(links), "node", "root"), "classed")
    mixed = classed.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).filter("_a <> _z").select("key")
    open_ = classed.join(mixed, "key")
    whole = open_.filter(F.col("_n") <= HOT).repartition("key").sortWithinPartitions("key")
    open_ = written(open_.filter(F.col("_n") > HOT).unionByName(whole.mapInArrow(_partnered(percent), whole.schema)).drop("n", "_all"), "open")
    own = _signs_of(open_.select("node").distinct(), signs)
    open_ = open_.join(own, "node").select("key", "_n", "node", "root", "n", "over", "bits")
    columns = ("key", "i", "j", "node", "n", "over", "root", "bits", "side")
    small = open_.filter(F.col("_n") <= HOT).select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")).select(*columns)
    tasks = small.unionByName(_block_tasks(open_.filter(F.col("_n") > HOT)).select(*columns))
    dealt = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(dealt.mapInArrow(_searched(percent, best), "a long, b long, key long"), "found")


def _block_tasks(rows: DataFrame) -> DataFrame:
    """Large files as blocks and pairs of blocks: i and j name them, side tells which of both a row is in."""
    sized = rows.withColumn("_c", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    parts = sized.groupBy("key", "_c").agg(F.ceil(F.count("*") / HOT).cast("int").alias("_m"))
    block = (F.col("_c") * 65536 + F.pmod(F.xxhash64("root"), F.col("_m")).cast("int")).alias("_b")
    blocks = written(sized.join(parts, ["key", "_c"]).select("*", block), "blocks")
    nodes = blocks.groupBy("key", "_c", "_b").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"), F.min("root").alias("_first"), F.max("root").alias("_last"))
    other = nodes.select("key", *[F.col(c).alias(f"{c}2") for c in ("_c", "_b", "_lo", "_hi", "_first", "_last")])
    near = nodes.join(other, "key").filter("_b <= _b2 AND _c2 - _c <= 1 AND NOT (_first = _last AND _first2 = _last2 AND _first = _first2)")
    near = near.select("key", F.col("_b").alias("i"), F.col("_b2").alias("j"))
    side = lambda c, s: blocks.join(near.select("key", "i", "j", F.col(c).alias("_b")), ["key", "_b"]).withColumn("side", s)
    whole = F.when(F.col("i") == F.col("j"), 2)
    return side("i", whole.otherwise(0)).unionByName(side("j", F.lit(1)).filter("i <> j"))
