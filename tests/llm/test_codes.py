import hashlib
import math
from collections import Counter

import numpy as np

from bidlattice.llm import codes, vectors

from .test_centroids import SCHEMA, made


def brute(rows, positions, entries, rounds, width, scale=1024):
    fine = [(i, v, label) for i, v, label, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = sorted(((i is None, i or 0, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in fine if len(v) == width), key=lambda r: r[:3])
    n, books, out = width // positions, [], [["", 0] for _ in whole]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for p in range(positions):
        parts = [v[p * n : (p + 1) * n] for _, _, v, _ in whole]
        c = parts[:entries]
        for step in range(rounds + 1):
            near = [min((far(v, m), k) for k, m in enumerate(c)) for v in parts]
            if step < rounds:
                for k in range(len(c)):
                    own = [v for v, (_, j) in zip(parts, near, strict=True) if j == k]
                    c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[k]
        books += [x for m in c for x in m]
        for o, (d, k) in zip(out, near, strict=True):
            o[0], o[1] = o[0] + f"{k:02x}", o[1] + d
    labels = Counter()
    for (*_, label), (_, d) in zip(whole, out, strict=True):
        labels[label] += d
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    found = [((-1 if null else i), code, d, labels[label], digest) for (null, i, _, label), (code, d) in zip(whole, out, strict=True)]
    return sorted(found) + [(i, None, None, labels.get(label), digest) for i, v, label in fine if len(v) != width]


def listed(df):
    got = [((-1 if r.vec_id is None else r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()]
    return sorted(r for r in got if r[1] is not None) + sorted(r for r in got if r[1] is None)


def test_equals_brute_force(spark, monkeypatch):
    rows = made(300, 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = brute(rows, 4, 16, 3, 8)
    assert listed(codes.compress(df, 4, 16, 3)) == want
    monkeypatch.setattr(vectors, "HOT", 10)  # the copies are hot, the rest is shuffled
    assert listed(codes.compress(df, 4, 16, 3)) == want


def test_few_rows_and_none(spark):
    df = spark.createDataFrame(made(6, 4)[:6], SCHEMA)
    assert [r.error for r in codes.compress(df).collect()] == [0] * 6
    assert codes.compress(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "x"), (2, [], 1, "x")], SCHEMA)
    assert listed(codes.compress(odd)) == [(1, None, None, None, None), (2, None, None, None, None)]


def test_nearest_is_exact_and_takes_the_first():
    rng = np.random.default_rng(0)
    for most in (50, vectors.MOST):
        x, e = rng.integers(-most, most, (500, 5)), rng.integers(-most, most, (30, 5))
        e[7] = e[3]
        d = ((x[:, None, :].astype(object) - e) ** 2).sum(2)
        code, far = vectors.nearest(x, e)
        assert code.tolist() == [min(range(30), key=lambda k: (r[k], k)) for r in d.tolist()] and far.tolist() == d.min(1).tolist()
