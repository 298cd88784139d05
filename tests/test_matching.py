import random

from pyspark.sql import functions as F

from bidlattice.operators import matching, store

from .test_store import NONE, entities


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a != b and 9 or 0
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return 1 if a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] else 9


def brute(rows, keys):
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = keys[i], keys[j]
            if not a or not b:
                continue
            x, y = set(a) - set(b), set(b) - set(a)
            near = len(x) == len(y) == 1 and len(a) == len(b) > 1 and all(w.isalpha() and len(w) >= matching.SHORT for w in x | y) and edits(*x, *y) == 1
            if a == b or near:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_keys(spark):
    names = ["  The ACME  Road-Works Ltd. ", "Roads & works, A.C.M.E. Inc", "Jo Smith DBA: Acme Works", "Ltd", "Company of one", "x dba", None, " - ", "Doe doing business as  Blue Sky  Limited"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = [r.k for r in df.orderBy("id").select(matching.key("name").alias("k")).collect()]
    assert got == [["acme", "road", "works"], ["acme", "roads", "works"], ["acme", "works"], ["ltd"], ["of", "one"], ["dba", "x"], None, [], ["blue", "sky"]]


def test_groups_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "alphas", "alpho", "gamma", "gama", "road", "roads", "roda", "x1", "x2", "sky", "skye", "blues", "blue", "works"]
    names = [" ".join(rng.sample(words, rng.randrange(1, 4))) + rng.choice(["", " Ltd", " INC."]) for _ in range(150)] + [f"hub {w}{v}" for w in ("alph", "betaa", "gammaa") for v in "abcdefgh"] + [None, "", "Ltd", "LTD."]
    rows = [(i, n, f"r{i % 3}") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name string, register string").repartition(5)
    keys = {r.id: r.k for r in df.select("id", matching.key("name").alias("k")).collect()}
    want = brute(rows, keys)
    assert {r.id: r["match"] for r in matching.matched(df).collect()} == want
    whole = {r["match"]: r for r in matching.merged(df).collect()}
    assert sum(r.rows for r in whole.values()) == len(rows) and whole.keys() == set(want.values())
    one = next(r for r in whole.values() if r.rows > 5)
    mine = [rows[i] for i, m in want.items() if m == one["match"]]
    assert one.name == rows[one["match"]][1] and one.aliases == sorted({n for _, n, _ in mine} - {one.name}) and one.registers == sorted({r for *_, r in mine})
    assert matching.matched(df.limit(0)).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 901), (902, 901)], "a long, b long"))
    got = {r.id: r.root for r in matching.components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and got[901] == got[902] == 900 and len(got) == 304


def test_a_reimport_keeps_uids(spark):
    rows = lambda *names: entities(spark, *[("company", n, {"scraper_id": i} if i else NONE, "x", 1.0) for n, i in names])
    old = store.merge_entities(store.empty(spark).entities, rows(("A", None), ("B", "7"), ("C", None), ("D", None)), "t")
    known = store.snapshot(old)
    had = {r.name: r.uid for r in old.collect()}
    new, problems = store.reimported(known, rows(("E", None), ("C", None), ("Renamed", "7"), ("a", None)), "t2")
    got = {r.name: r.uid for r in new.collect()}
    assert (got["C"], got["Renamed"], got["a"]) == (had["C"], had["B"], had["A"]) and got["E"] not in had.values() and problems.count() == 0
    later = {r.name: r.uid for r in store.reimported(known, rows(("F", None), ("E", None)), "t3", new)[0].collect()}
    assert later["E"] == got["E"] and len(set(later.values()) | {had["D"]}) == len(later) + 1  # D's uid is not given again
    moved = new.withColumn("uid", F.when(F.col("name") == "C", F.lit("CMP-00000099")).otherwise(F.col("uid")))
    assert [r.problem for r in store.reimported(known, rows(("C", None)), "t4", moved)[1].collect()] == ["uid changed"]
