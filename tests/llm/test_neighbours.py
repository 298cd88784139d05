import numpy as np

from bidlattice.llm import neighbours


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        d = [(float(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())), i) for i in vectors if i != q]
        out[q] = sorted(d)[:k]
    return out


def test_recall_scores_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    fine = {i: np.round(centres[i % 12] + 0.4 * rng.normal(size=8), 3) for i in range(1500)}
    fine |= {i: np.ones(8) for i in range(2000, 2600)}  # one very common vector
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] + [1.0] * 7), (5003, [None] + [1.0] * 7), (5004, [float("inf")] * 8), (5100, [1.0, 2.0]), (None, [1.0] * 8), (5200, [])]
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in fine.items()] + [(i, v, 2) for i, v in odd], "vec_id long, embedding array<double>, v int")
    got = {}
    for r in neighbours.search(rows, rows.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    want = brute(fine, [i for i in fine if i % 100 == 0], 10)
    assert set(got) == set(want)
    hit = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((fine[i] - fine[q]) ** 2).sum())) < 1e-12 for s, i, _ in found)
        assert found == sorted(found)
    assert [i for _, i, _ in got[2000]] == list(range(2001, 2011))


def test_few_rows_and_none(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [4.0, 6.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(rows, rows.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 5.0)]
    assert neighbours.search(rows.limit(0), rows).count() == 0
    assert neighbours.search(rows, rows.limit(0)).count() == 0
    assert neighbours.search(rows.limit(1), rows.limit(1)).count() == 0


def test_calibration_uses_distinct_vectors_outside_the_fit():
    x = np.random.default_rng(3).normal(size=(600, 4))
    x[::3] = x[0]
    kept, which = neighbours._hold_out(x)
    held = {tuple(v) for v in x[which].tolist()}
    assert len(held) == len(which) == neighbours.CALIBRATION and not held & {tuple(v) for v in kept.tolist()}
