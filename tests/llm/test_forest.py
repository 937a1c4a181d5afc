"""op12's search gives no more pairs than a file has rows, and loses no link by it."""

import random

import numpy as np
import pyarrow as pa

from caregrid.llm import jaccard, signature_tree


def test_spanning_joins_what_all_pairs_join():
    rng = np.random.default_rng(1)
    for size, many in ((2, 1), (30, 40), (400, 3000), (400, 150)):
        a, b = rng.integers(0, size, (2, many)) * 10
        a, b = a[a != b], b[a != b]
        score = rng.random(len(a)).round(1)  # ties too

        def classes(x, y):
            root = {}

            def find(k):
                while root.setdefault(k, k) != k:
                    k = root[k]
                return k

            for i, j in zip(x.tolist(), y.tolist()):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
            return {k: find(k) for k in root}

        some = signature_tree.spanning(a, b, score)
        every = classes(a, b)
        assert classes(a[some], b[some]) == every and len(some) == len(every) - len(set(every.values()))


def test_a_large_file_gives_a_forest():
    """150 sets that all may link: at most a pair for each set, and the file's key once more."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    sets = [np.unique(np.concatenate([base[:190], rng.integers(0, 1 << 63, 10, np.uint64)])) for _ in range(150)]
    signs = [signature_tree.signature(s) for s in sets]
    ids = np.arange(150)
    rows = [np.full(150, 7), ids * 0, ids * 0, ids, np.array([len(s) for s in sets]), np.array([k for _, k in signs]), ids, [x for x, _ in signs], ids * 0 + 2]
    names = ["key", "i", "j", "node", "n", "over", "root", "bits", "side"]
    batch = pa.record_batch([pa.array(x) for x in rows], names)
    found = pa.Table.from_batches(list(signature_tree._searched(80, True)([batch]))).to_pylist()
    assert sum(r["a"] is not None for r in found) == 149 and [r["key"] for r in found if r["a"] is None] == [7]


def test_pairs_beside_the_forest_are_compared(spark):
    """Sets near the least similarity, where the best pair of a forest may not link: classes are those of all pairs."""
    rng = random.Random(4)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
