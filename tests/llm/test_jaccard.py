import random
import re

import numpy as np
import pytest

from bidlattice.llm import jaccard

from .cases import TEXTS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + min(k, len(w))]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def brute(texts, k, num, den):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def made(seed=2, copies=220):
    rng = random.Random(seed)
    texts = list(TEXTS) + ["a b c", "a b c d", "A b C d e", "a b", "b a", "a b c d e f g h i j k", "a b c d e f g h i j"]
    seeds = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (3, 6, 12, 13, 20, 25, 40, 60, 100, 180, 400)]
    seeds += [" ".join(f"v{rng.randrange(6)}" for _ in range(n)) for n in (8, 15, 30)]
    for _ in range(copies):
        w = rng.choice(seeds).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, len(w) // 20, len(w) // 30])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [f"e{rng.randrange(50)}"] * rng.randrange(2)
        texts.append(" ".join(w) or "z")
    return texts


@pytest.mark.parametrize(("k", "similarity", "chunk"), [(3, (90, 100), 1024), (5, (80, 100), 16)])
def test_equals_brute_force(spark, monkeypatch, k, similarity, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = made()
    rows = jaccard.join(documents(spark, texts).repartition(5), k, similarity).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, k, *similarity)


def test_linked_sets_share_keys():
    rng = np.random.default_rng(1)
    for num in (90, 80, 60):
        like = jaccard.Likeness(num, 100)
        for n in [*range(1, 40), 100, 333, 1000]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                apart = int(2 * n * (100 - num) / (100 + num))
                b = np.unique(np.append(a[min(int(rng.integers(0, n + 1)), apart) :], rng.integers(0, 2**63, int(rng.integers(0, apart + 2))).astype(np.uint64)))
                if len(b) and like.linked(len(a), len(b), len(np.intersect1d(a, b))):
                    frequent = rng.permutation(a)[: int(rng.integers(0, n + 1))]
                    key, row = jaccard.keys(np.append(a, b), np.array([0, len(a), len(a) + len(b)]), like, frequent)
                    shared = len(np.intersect1d(key[row == 0], key[row == 1]))
                    assert shared >= max(like.lead(like.least(len(x))) for x in (a, b)) > 0


def sets_like(base, n, rng):
    out = [np.unique(np.append(base[rng.random(len(base)) < rng.choice([0.5, 0.9, 0.97])], rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64))) for _ in range(n)]
    return sorted(out, key=len)


def test_traversal_keeps_every_linked_pair_and_prunes_others():
    rng = np.random.default_rng(4)
    like = jaccard.Likeness(80, 100)
    sets = sets_like(rng.integers(0, 2**63, 60).astype(np.uint64), 120, rng)
    sizes = np.array([len(s) for s in sets])
    common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for b in range(120) for a in range(b)}
    linked = {p for p, c in common.items() if like.linked(len(sets[p[0]]), len(sets[p[1]]), c)}
    for bits, length in (([512] * 120, 8), ([64, 512, 256] * 40, 4), ([128, 256] * 60, 4)):  # as long, folded and repeated maps
        maps, excess = jaccard.fitted([jaccard.bitmap(s, n) for s, n in zip(sets, bits, strict=True)], sizes, length)
        levels = jaccard.tree(maps, sizes, excess, np.arange(120))
        assert all(-(-x.maps.shape[0] // jaccard.FAN) == y.maps.shape[0] for x, y in zip(levels, levels[1:], strict=False))
        i, j, most = jaccard.traverse(levels, levels, like, True)
        found = set(zip(i.tolist(), j.tolist(), strict=True))
        assert linked <= found and len(found) < len(common)
        assert all(common[p] <= m for p, m in zip(zip(i.tolist(), j.tolist(), strict=True), most.tolist(), strict=True))
    assert len(jaccard.candidates([jaccard.bitmap(s, 512) for s in sets], sizes, np.arange(120), np.zeros(120), like)[0]) < len(common) / 2


def test_trees_join_what_is_linked_and_no_more():
    rng = np.random.default_rng(5)
    like = jaccard.Likeness(80, 100)
    sets = sets_like(rng.integers(0, 2**63, 40).astype(np.uint64), 90, rng)
    maps, sizes = [jaccard.bitmap(s, 256) for s in sets], np.array([len(s) for s in sets])

    def find(root, side):
        return jaccard.links(sets, root, *jaccard.candidates(maps, sizes, root, side, like), like)

    def parts(pairs):
        root = list(range(90))
        for p, q in pairs:
            root = [min(root[p], root[q]) if r in (root[p], root[q]) else r for r in root]
        return root

    linked = [(a, b) for b in range(90) for a in range(b) if like.linked(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))]
    found = find(np.arange(90), np.zeros(90))
    assert set(map(tuple, map(sorted, found))) <= set(linked) and len(found) < len(linked)
    assert parts(found) == parts(linked)
    side = rng.integers(0, 2, 90)
    assert parts(find(np.arange(90), side)) == parts([(a, b) for a, b in linked if side[a] != side[b]])
    assert not find(np.ones(90, int), np.zeros(90))


def test_null_ids_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "A b c d"), (4, "a b c d"), (None, "q r s t"), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(docs, 3, (90, 100)).collect())
    assert got == [("4", 2, "4"), ("4", 2, "4"), ("7", 0, "7"), ("None", 2, "4"), ("None", 2, "4"), ("None", 2, "None")]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_crafted_words_do_not_link(spark):
    """Words made so that a polynomial hash of any odd base calls them equal are two words."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    many = " ".join(f"w{i}" for i in range(19))
    rows = jaccard.join(documents(spark, [a, b, f"{many} {a}", f"{many} {b}"]), 3, (90, 100)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_rows_with_shared_keys_are_dealt_once(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60) - 30, rng.randrange(40), 7) for _ in range(90)] + [(99, 1, 7), (99, 1, 7), (98, 5, 7), (98, -5, 7)]
    df = jaccard.shared(spark.createDataFrame(rows, "key long, set long, n int").repartition(3)).distinct()
    sets = {}
    for k, s, _ in rows:
        sets.setdefault(k, set()).add(s)
    assert sorted(map(tuple, df.collect())) == sorted({r for r in rows if len(sets[r[0]]) > 1})
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("hashpartitioning(") == 1  # a join with the keys would deal them again
