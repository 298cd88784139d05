"""Centroid clustering: plain Lloyd over integer vectors, centroids broadcast, sums of partitions merged by a grouping."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, stored
from . import vectors

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256, 2


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster, the lowest of equals, and squared distance: one row of integer differences after another."""
    d = np.empty((len(centroids), len(x)), np.int64)
    for k, c in enumerate(centroids):
        apart = x - c
        d[k] = np.einsum("ij,ij->i", apart, apart)
    best = d.argmin(0)
    return best, d[best, np.arange(len(x))]


def _rows(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.int64)


def _sums(centroids):
    """(cluster, n, s): of each cluster that a partition has, its number of vectors and their sum."""

    def run(batches):
        c = centroids.value
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            if len(b):
                x = _rows(b["v"])
                best, _ = assigned(x, c)
                n += np.bincount(best, minlength=len(c))
                order = np.argsort(best, kind="stable")
                own, at = np.unique(best[order], return_index=True)
                s[own] += np.add.reduceat(x[order], at)
        own = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": own.astype(np.int32), "n": n[own], "s": list(s[own])})

    return run


def _place(centroids):
    def run(batches):
        for b in batches:
            if len(b):
                best, distance = assigned(_rows(b["v"]), centroids.value)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": best.astype(np.int32), "distance": distance})

    return run


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of exactly ``width`` components, none
    null or non-finite; other rows take no part.

    Components x become floor(scale * x). The first centroids are the vectors whose id has the smallest sha256 of
    ``<seed>:<vec_id>``; rows that share an id come in the order of their vectors, null ids last, and equal vectors may
    be several centroids. A round broadcasts the centroids, a fixed number of them, assigns every vector (ties to the
    lower number), and merges one row of integer sums for each cluster and partition; no vector moves. Centroids become
    floored means, and those without vectors stay. Fewer vectors than clusters: each vector is a centroid. No vectors:
    no rows. Rows that share an id are rows of their own. A component beyond ``vectors.MOST`` stops the job."""
    spark = rows.sparkSession
    prepare(spark)
    usable = vectors.finite(F.col(embedding)) & (F.size(embedding) == width)
    kept = stored(rows.filter(usable).select(F.col(vec_id).cast("long").alias("vec_id"), vectors.integers(F.col(embedding), scale).alias("v")), "integers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = kept.orderBy(order, "v").limit(clusters).collect()  # as many as clusters
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    c = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        found = kept.select("v").mapInPandas(_sums(spark.sparkContext.broadcast(c)), "cluster int, n long, s array<long>")
        merged = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))
        c = c.copy()
        for r in merged.collect():  # a row for each cluster
            c[r.cluster] = [x // r.n for x in r.s]
    placed = stored(kept.mapInPandas(_place(spark.sparkContext.broadcast(c)), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    table = spark.createDataFrame([(k, d, sum(inertia.values()), digest[k]) for k, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select(*[x.split()[0] for x in schema.split(", ")])  # a row for each cluster


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    d = "list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda i: f"a{i} as materialized (select vec_id, any_value(k.v) as v, arg_min(c, (d, c)) as c, min(d) as d from (select k.vec_id, k.v, m.c, {d}::bigint as d from k, c{i} m) k group by 1)"
    steps = [
        f"k as materialized (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {WIDTH})",
        f"h as (select v, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c from k)",
        f"c0 as materialized (select c, v from h where c < {CLUSTERS})",
    ]
    for i in range(ROUNDS):
        mean = "list(((s - ((s % n) + n) % n) // n)::bigint order by p)"
        steps += [near(i), f"s{i} as (select c, {mean} as v from (select c, p, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range({WIDTH})) as p from a{i}) group by 1, 2) group by 1)"]
        steps += [f"c{i + 1} as materialized (select o.c, coalesce(n.v, o.v) as v from c{i} o left join s{i} n on n.c = o.c)"]
    steps += [near(ROUNDS)]
    return f"""with {", ".join(steps)} select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(m.v, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} m on m.c = a.c"""


ORACLE = _oracle()
