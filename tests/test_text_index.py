import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from bidlattice.operators import search, text_index
from bidlattice.streaming import versions

SCHEMA = "id string, body string"


def texts():
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("red green blue Red greenish blueberry a b the of".split()) for _ in range(n))
    fixed = [None, "", " ", "a a a a", "a b a b a", "of the", "the of the", "re-use", "re use", "Red, green; BLUE!", "blue green red blue", "x", "a the b"]
    return {f"d{i:03d}": t for i, t in enumerate(fixed + [some(rng.randrange(1, 40)) for _ in range(200)])}


def rows(spark, found):
    return spark.createDataFrame(list(found.items()), SCHEMA)


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def ranked(t, asked):
    """By brute force: every span of the text is tried."""
    w = tokens(t)
    places = lambda p: [(i, i + len(p) - 1) for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]
    fitting = [must for must, not_ in asked if all(places(p) for p in must) and not any(places(p) for p in not_)]
    if not fitting:
        return None
    wanted = {x for must, _ in asked for p in must for x in p}
    whole = lambda a, b: any(must and all(any(a <= s and e <= b for s, e in places(p)) for p in must) for must in fitting)
    spans = [(a, b) for a, b in itertools.combinations_with_replacement(range(len(w)), 2) if whole(a, b)]
    covers = [s for s in spans if not any(s != o and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return round(sum(0.1 / (1 + sum(x not in wanted for x in w[a : b + 1])) for a, b in covers), 6)


@pytest.fixture(scope="module")
def target(spark):
    return text_index.indexed(rows(spark, texts()), "id", "body")


@pytest.mark.parametrize("query", [
    "red", "red green", '"a a"', "a a", '"of the"', '"the of the" or x', "red -green", '"red green" -"green blue" or "a b a"', "-red", '-"a a" -red or x', "re-use", 'blue or "green red"', '"" or red or', "or", "", '-""', "nosuchword", "red nosuchword", "green red green", '"red" "blue" a',
])
def test_matching_equals_brute_force(spark, target, query):
    asked = text_index.alternatives(query)
    want = {k: r for k, t in texts().items() if asked and (r := ranked(t, asked)) is not None}
    got = {r.key: r.rank for r in text_index.match(spark, target, query).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_what_a_query_asks_for():
    assert text_index.alternatives('Red "the  Cat" -blue or -"x y" OR "') == [([("red",), ("the", "cat")], [("blue",)]), ([], [("x", "y")])]
    assert text_index.alternatives("- ! or \"\"") == []


def test_best_matches(spark, target):
    best = [(r.key, r.rank) for r in text_index.match(spark, target, "red green", 5).collect()]
    every = sorted(((r.rank, r.key) for r in text_index.match(spark, target, "red green").collect()), key=lambda x: (-x[0], x[1]))
    assert best == [(k, s) for s, k in every[:5]]


def same_scores(spark, target, found, query, limit=None):
    want = {r.key: r.score for r in search.bm25(rows(spark, found), "id", "body", query).collect()}
    assert {r.key: r.score for r in text_index.bm25(spark, target, query).collect()} == want
    if limit:
        best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:limit]
        assert [(r.key, r.score) for r in text_index.bm25(spark, target, query, limit).collect()] == best


def files(spark, target):
    fs = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found, it = {}, fs.listFiles(spark._jvm.org.apache.hadoop.fs.Path(target), True)
    while it.hasNext():
        f = it.next()
        found[f.getPath().toString()] = (f.getLen(), f.getModificationTime())
    return found


def test_texts_come_again_go_and_segments_merge(spark, monkeypatch):
    found = texts()
    target = text_index.indexed(rows(spark, found), "id", "body")
    for query, limit in (("red", 3), ("red blue", 10), ("gre", 7), ("", None), ("zzz", 2)):
        same_scores(spark, target, found, query, limit)
    for k in range(5):
        before = files(spark, target)
        more = {f"d{i:03d}": f"red blue {k} " * (i % 4) for i in range(k * 10, k * 10 + 20)} | {f"n{k}{i}": "greenest red" for i in range(3)}
        names = text_index.append(spark, target, rows(spark, more), "id", "body")
        assert before.items() <= files(spark, target).items()  # nothing is written again
        found |= more
    same_scores(spark, target, found, "red gre", 10)
    assert names["texts"] == len(found) and names["words"] == sum(len(tokens(t)) for t in found.values())
    gone = [f"d{i:03d}" for i in range(40, 60)] + ["unknown"]
    text_index.remove(spark, target, spark.createDataFrame([(g,) for g in gone], "key string"))
    found = {k: t for k, t in found.items() if k not in gone}
    same_scores(spark, target, found, "red gre", 10)
    merged = text_index.merge(spark, target, 2)
    assert len(merged["segments"]) < 6 and sum(s["texts"] for s in merged["segments"]) == len(found) + sum(d["rows"] for d in merged["dead"])
    same_scores(spark, target, found, "red gre", 10)
    back = {gone[0]: "red again"}
    text_index.append(spark, target, rows(spark, back), "id", "body")
    same_scores(spark, target, found | back, "red again", 5)
    assert text_index.match(spark, target, "again").count() == 1


def test_repeated_and_null_keys_and_no_texts(spark):
    df = spark.createDataFrame([("a", "one"), ("a", "two words"), (None, "lost"), ("b", None)], SCHEMA)
    target = text_index.indexed(df, "id", "body")
    assert versions.read(spark, target)["texts"] == 2
    assert [r.key for r in text_index.bm25(spark, target, "two one lost").collect()] == ["a"]
    assert {r.key for r in text_index.match(spark, target, "-one").collect()} == {"a", "b"}
    empty = text_index.indexed(df.limit(0), "id", "body")
    assert text_index.bm25(spark, empty, "one", 3).count() == 0 and text_index.match(spark, empty, "-one").count() == 0


def test_only_files_and_blocks_that_may_matter_are_read(spark, monkeypatch):
    monkeypatch.setattr(text_index, "FILE_ROWS", 2000)
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.concat_ws(" ", F.expr("transform(sequence(1, 12), i -> concat('w', pmod(xxhash64(id, i), 500)))"), F.when(F.expr("id % 1000 = 7"), F.lit("w499 w498 w499 w498 w499 w498"))).alias("body"))
    target = text_index.indexed(df, "id", "body")
    every = spark.read.parquet(f"{target}/postings/*").inputFiles()
    hits = text_index.postings(spark, target, ["w17"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert 1 <= len(hits.inputFiles()) <= 2 < len(every) // 4
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w17)]" in plan
    begins = text_index.postings(spark, target, ["w17"], True)
    assert "StringStartsWith(term,w17)" in begins._jdf.queryExecution().executedPlan().toString()
    read = []
    real = text_index._in_blocks
    monkeypatch.setattr(text_index, "_in_blocks", lambda rows, blocks: (read.append(blocks.count()), real(rows, blocks))[1])
    best = [r.key for r in text_index.bm25(spark, target, "w499 w498", 4).collect()]
    want = search.bm25(df, "id", "body", "w499 w498").orderBy(F.desc("score"), "key").limit(4)
    assert best == [r.key for r in want.collect()] and read[1] < 125 // 4  # of 125 blocks


def test_a_text_is_a_row_for_each_term_before_any_shuffle(spark):
    found = texts()
    df = rows(spark, found).select(F.col("id").alias("key"), search.terms("body").alias("terms"))
    got = text_index._placed(df, {"key": "string"}).collect()
    assert {(r.key, r.length) for r in got if r.term is None} == {(k, len(tokens(t))) for k, t in found.items()}
    want = {(k, w): [i for i, x in enumerate(tokens(t)) if x == w] for k, t in found.items() for w in tokens(t)}
    assert {(r.key, r.term): r.positions for r in got if r.term is not None} == want and len(got) == len(want) + len(found)
