import random
import re

from bidlattice.llm import substrings

from .cases import TEXTS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    seen, out = set(), {}
    for d, t in enumerate(texts):
        mine = WORD.findall(t or "")
        gone = set()
        for s in range(len(mine) - 19):
            w = tuple(mine[s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        out[d] = (len(mine), len(gone), " ".join(x for i, x in enumerate(mine) if i not in gone))
    return out


def made():
    rng = random.Random(11)
    some = lambda n, v=5000: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    passages = [some(n) for n in (15, 19, 20, 21, 30, 60, 200)] + ["x " * 70, some(80, 2), some(120, 4)]
    texts = list(TEXTS)
    for _ in range(250):
        parts = [some(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages).split()
            a = rng.randrange(len(p))
            parts += [" ".join(p[a:] if rng.random() < 0.5 else p), some(rng.choice([0, 0, 1, 3, 25]))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    for t in [texts[rng.randrange(len(texts))] for _ in range(60)]:
        w = (t or "").split()
        for _ in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    return texts


def test_equals_brute_force(spark):
    texts = made()
    rows = substrings.without_repeats(documents(spark, texts).repartition(7)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute(texts)


def test_shared_and_null_ids_and_no_rows(spark):
    t = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, t), (1, t), (1, "b " + t), (2, t), (None, t), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 9), r.n_words, r.n_removed) for r in substrings.without_repeats(docs).collect())
    assert got == [(1, 40, 0), (1, 40, 0), (1, 41, 0), (2, 40, 40), (9, 0, 0), (9, 40, 40)]
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_crafted_words_are_not_removed(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    many = " ".join(f"w{i}" for i in range(19))
    rows = substrings.without_repeats(documents(spark, [f"{many} {a}", f"{many} {b}", f"{many} {a}"])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(0, 0), (1, 0), (2, 20)]
