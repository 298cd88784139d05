"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import prepare, stored

SAMPLE = 16384  # vectors that the tree is fitted on
BRANCH = 8  # children of a node
LEAF = 32  # fitted vectors in a leaf, at most
CALIBRATION = 64  # vectors whose exact neighbours set how many leaves a search visits
RECALL = 0.97  # that the visited leaves must reach on them
BLOCK_ROWS = (64, 8192)  # least and most rows that one task compares at once
QUERY_ROWS = 8192  # and most queries
BLOCKS = 64  # into which a table is divided while that keeps blocks between those sizes


def usable(v: Column) -> Column:
    """Not null, not empty, not all zero, and all components finite."""
    x = F.transform(v, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(fine & F.exists(x, lambda c: c != 0), F.lit(False))


class Tree:
    """centres: of all nodes; children: first child and number of children (0: leaf); leaf: number of a leaf."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        sample = np.unique(sample, axis=0)  # a vector that many rows share must not draw the leaves to itself
        self.centres, self.children = [sample.mean(0) if len(sample) else np.zeros(0)], [(0, 0)]
        todo = [(0, sample)]
        while todo:
            node, own = todo.pop()
            if len(own) <= LEAF:
                continue
            means, part = _k_means(own, BRANCH, rng)
            if len(means) < 2:
                continue
            self.children[node] = (len(self.centres), len(means))
            for k, m in enumerate(means):
                todo.append((len(self.centres), own[part == k]))
                self.centres.append(m)
                self.children.append((0, 0))
        self.centres = np.array(self.centres)
        self.leaf = np.cumsum([n == 0 for _, n in self.children]) - 1
        self.n_leaves = int(self.leaf[-1]) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node the nearest child, the first of equals."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            first, n = self.children[node]
            if not n or not len(rows):
                at[rows] = node
                continue
            c = self.centres[first : first + n]
            part = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(first + k, rows[part == k]) for k in range(n)]
        return self.leaf[at]

    def leaves(self, q: np.ndarray, most: int) -> list[int]:
        """The leaves that a search visits for ``q``, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            first, n = self.children[node]
            while n:  # down to a leaf; the other branches wait in the queue
                d = ((self.centres[first : first + n] - q) ** 2).sum(1)
                best = int(d.argmin())
                for k in range(n):
                    if k != best:
                        heapq.heappush(queue, (float(d[k]), first + k))
                node = first + best
                first, n = self.children[node]
            out.append(int(self.leaf[node]))
        return out


def _k_means(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    means = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        part = ((means * means).sum(1) - 2 * x @ means.T).argmin(1)
        used = np.unique(part)
        means = np.array([x[part == j].mean(0) for j in used])
    part = ((means * means).sum(1) - 2 * x @ means.T).argmin(1)
    used, part = np.unique(part, return_inverse=True)
    return means[used], part


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list array, all of one length, in double precision."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query_id, vec_id, score) of the k nearest rows to each query but itself; equals by smaller id."""
    out = []
    for one, own in zip(q, q_ids, strict=True):
        d = np.sqrt(((x - one) ** 2).sum(1))
        d[ids == own] = np.inf
        if len(d) > k:
            some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            some = some[np.lexsort((ids[some], d[some]))][:k]
        else:
            some = np.lexsort((ids, d))
        some = some[np.isfinite(d[some])]
        out.append((np.full(len(some), own), ids[some], d[some]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


_FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k nearest of ``vectors`` (vec_id, v) to each of a few query vectors, by comparing all."""
    held = vectors.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches):
        q, own = held.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _nearest(q, own, _matrix(b.column("v")), b.column("vec_id").to_numpy(), k)], ["query_id", "vec_id", "score"])

    return _best(vectors.mapInArrow(run, _FOUND), k)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found to each query: Euclidean, in double precision, ties to the smaller id.

    The tree is fitted on at most SAMPLE vectors, the first in an order of hashes; every row is put in a leaf. The
    number of leaves to visit is the least that reaches ``recall`` on CALIBRATION distinct vectors that the tree is not
    fitted on, whose true neighbours come from comparing all rows. Small leaves share blocks; a leaf with many rows, such as copies of one vector, is dealt
    into several, and a block visited by many queries meets them in groups, so no task holds more than a block.
    Vectors null, empty, zero or with null or non-finite components take no part, nor do null ids and vectors of
    another length than the sample's most common one. A query is not its own neighbour; rows that share an id are
    candidates each. No usable rows or queries: no rows; fewer than k candidates: all of those found."""
    spark = rows.sparkSession
    prepare(spark)
    both = [t.filter(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")) for t in (rows, queries)]
    order = [F.xxhash64("vec_id"), "vec_id"]
    sample = both[0].orderBy(*order).limit(SAMPLE).toArrow()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample.num_rows:
        return none
    width = np.bincount([len(x) for x in sample["v"]]).argmax()
    base, asked = (t.filter(F.size("v") == int(width)) for t in both)
    same = sample.filter(pa.compute.equal(pa.compute.list_value_length(sample["v"]), int(width))).combine_chunks()
    fitted = _matrix(same["v"].chunk(0))
    kept, which = _hold_out(fitted)
    tree = Tree(kept)
    visits = _calibrate(base, tree, same["vec_id"].to_numpy()[which], fitted[which], k, recall)
    held = spark.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(held.value.assign(_matrix(b.column("v"))), pa.int64())], ["vec_id", "v", "leaf"])

    placed = stored(base.mapInArrow(place, "vec_id long, v array<double>, leaf long"), "leaves")
    counts = np.zeros(tree.n_leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # as many rows as leaves: bounded by the sample
        counts[r.leaf] = r["count"]
    first, blocks = _deal(counts)
    cut = F.broadcast(spark.createDataFrame(list(zip(range(tree.n_leaves), first.tolist(), blocks.tolist(), strict=True)), "leaf long, first int, blocks int"))
    bins = spark.sparkContext.broadcast((tree, first, blocks))

    def route(batches):
        tree, first, blocks = bins.value
        for b in batches:
            rows, at, lists = [], [], []
            for k, q in enumerate(_matrix(b.column("v"))):
                mine: dict[int, list[int]] = {}
                for leaf in tree.leaves(q, visits):
                    for j in range(first[leaf], first[leaf] + blocks[leaf]):
                        mine.setdefault(int(j), []).append(leaf)
                rows += [k] * len(mine)
                at += mine.keys()
                lists += mine.values()
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(rows), b.column("v").take(rows), pa.array(at, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], ["vec_id", "v", "block", "leaves"])

    routed = stored(asked.mapInArrow(route, "vec_id long, v array<double>, block int, leaves array<long>"), "visits")
    asks = F.broadcast(routed.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups")))  # one row a block
    mine = placed.join(cut, "leaf").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int"))
    mine = mine.join(asks, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    theirs = routed.join(asks, "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
    keys = ["block", "part"]

    def compare(q: pa.Table, x: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and x.num_rows:
            x = x.combine_chunks()
            v, ids, leaf = _matrix(x["v"].chunk(0)), x["vec_id"].to_numpy(), x["leaf"].to_numpy()
            order = np.argsort(leaf, kind="stable")
            v, ids, leaf = v[order], ids[order], leaf[order]
            for own, one, visited in zip(q["vec_id"].to_pylist(), q["v"].to_pylist(), q["leaves"].to_pylist(), strict=True):
                use = np.isin(leaf, visited)
                out.append(_nearest(np.array([one]), np.array([own]), v[use], ids[use], k))
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    theirs, mine = theirs.select(*keys, "vec_id", "v", "leaves"), mine.select(*keys, "vec_id", "v", "leaf")
    found = theirs.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInArrow(compare, _FOUND)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _deal(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each leaf's first block and number of blocks: neighbouring small leaves share one, a large leaf has several of its own."""
    most = min(max(BLOCK_ROWS[0], int(counts.sum()) // BLOCKS), BLOCK_ROWS[1])
    first, blocks, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > most:
            at, held = at + 1, 0
        first[leaf], blocks[leaf] = at, max(1, -(-n // most))
        if blocks[leaf] > 1:
            at, held = at + int(blocks[leaf]), 0
        else:
            held += n
    return first, blocks


def _hold_out(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors to fit on, and the rows of the first CALIBRATION distinct others (a quarter of all distinct at most)."""
    _, first, same = np.unique(sample, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)[: min(CALIBRATION, len(first) // 4)]
    return sample[~np.isin(same.ravel(), order)], first[order]


def _calibrate(base: DataFrame, tree: Tree, ids: np.ndarray, vectors: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves whose visit finds ``recall`` of the true neighbours of the given vectors."""
    if tree.n_leaves == 1 or not len(ids):
        return 1
    truth = exact(base, ids, vectors, k).join(base, "vec_id").select("query_id", "v").toPandas()
    if truth.empty:
        return 1
    leaf = tree.assign(np.array(truth["v"].tolist()))
    ranks = {int(i): {x: r for r, x in enumerate(tree.leaves(q, tree.n_leaves))} for i, q in zip(ids, vectors, strict=True)}
    need = sorted(ranks[int(i)][int(x)] + 1 for i, x in zip(truth["query_id"], leaf, strict=True))
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0))
