import random
import re

from bidlattice.llm import decontaminate

from .cases import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def to_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    out = {}
    for d, t in enumerate(texts):
        mine, hit, found = to_words(t), set(), set()
        for i, item in items:
            theirs = to_words(item)
            n = min(10, len(theirs))
            windows = {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)} if n else set()
            for s in range(len(mine) - n + 1):
                if n and tuple(mine[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found.add(i)
        out[d] = (len(mine), sorted(hit), sorted(found))
    return out


def test_equals_brute_force_in_one_block_and_in_many(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["Aa", "b", "c9", "é", "D-d", "e", "f", "g'", "h", "ij"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 3, 4, 6, 9, 10, 12, 30]))) for i in range(24)] + [(100, None), (101, "... !"), (None, "b c9")]
    texts = [None, "", "b"]
    for _ in range(60):
        item = rng.choice(items)[1] or ""
        texts.append(" ".join([some(rng.randrange(12)), item[rng.randrange(len(item) + 1) :], some(rng.randrange(8)), item if rng.random() < 0.4 else ""]))
    want = brute(texts, [x for x in items if x[0] is not None])
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.hit_spans(documents(spark, texts), table).collect()
        assert {r.doc_id: (r.n_words, [w for s in r.hit_spans for w in range(s.start, s.stop)], r.hit_items) for r in got} == want


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.hit_items for r in decontaminate.hit_spans(documents(spark, ["a b"]), none).collect()] == [[]]
    assert decontaminate.hit_spans(documents(spark, []), none).count() == 0
