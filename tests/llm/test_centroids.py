import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PythonException  # noqa: F401

from bidlattice.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def usable(v, width):
    return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, clusters, rounds, width, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if usable(v, width)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        near = [min((far(v, m), k) for k, m in enumerate(c)) for _, v in kept]
        if step < rounds:
            for k in range(len(c)):
                own = [v for (_, v), (_, j) in zip(kept, near, strict=True) if j == k]
                c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[k]
    total = sum(d for d, _ in near)
    inertia = [sum(d for d, j in near if j == k) for k in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((-1 if i is None else i), k, d, inertia[k], total, digest[k]) for (i, _), (d, k) in zip(kept, near, strict=True))


def made(n=300, width=6):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(rng.integers(0, 5), 0.3, width)], int(i % 3), "x") for i in range(n)]
    rows += [(n + i, rows[0][1], 1, None) for i in range(40)]  # copies of one vector
    rows += [(3, rows[5][1], None, "x"), (None, rows[7][1], 1, "x"), (None, rows[7][1], 1, "x")]  # shared and null ids
    bad = [None, [], [1.0] * (width - 1), [1.0] * (width + 1), [math.nan] * width, [math.inf] + [0.0] * (width - 1), [None] + [0.0] * (width - 1)]
    return rows + [(1000 + k, v, None, "x") for k, v in enumerate(bad)] + [(2000, [0.0] * width, 0, "x"), (2001, [-0.0] * width, 0, "x")]


def test_equals_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sorted(((-1 if r.vec_id is None else r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, 9, 4, 6).collect())
    assert got == brute(rows, 9, 4, 6)


def test_few_vectors_no_vectors_and_far_components(spark):
    rows = made(5, 4)[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.distance for r in centroids.cluster(df, 40, 2, 4).collect()] == [0] * 5
    assert centroids.cluster(df.limit(0), 40, 2, 4).count() == 0 and centroids.cluster(df, width=64).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 4, 1, "x")], SCHEMA), 2, 1, 4).count()
