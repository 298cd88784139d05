"""Pairs of companies counted by what they share, without a shuffle of pairs.

Companies are numbered in the order of their uids, and ranges of numbers are blocks. What is shuffled is each key's list
of companies, once for each block that has one of them; pairs are made and counted in their block's task, which has
all of a company's pairs, by Arrow and numpy. A list's companies are numbers of four bytes, so a key of a million companies is a row of
4 MB, and its pairs are a million times as many."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from . import store

BLOCK_ROWS = 8_000_000  # pairs made by one block on average, before they are counted
BLOCKS = 16  # at least, where there are so many companies


class Kind(NamedTuple):
    """What two companies may share: (company, key) of the first, of the second if others, and of thirds whose number counts.

    ``edges``: rows count and not keys, so a key that the first has twice and the second once counts two.
    ``far``: (company, third), whose common thirds count for pairs without a common key; such pairs may be all there are,
    so they are counted in tiles (see ``_tiled``)."""

    first: DataFrame
    second: DataFrame | None = None
    third: DataFrame | None = None
    edges: bool = False
    far: DataFrame | None = None


class Counted(NamedTuple):
    """(a, b, counts..) by numbers of companies, and (uid, n), how these are numbered."""

    pairs: DataFrame
    numbers: DataFrame
    n: int

    def top(self, order: list, limit: int | None) -> Counted:
        """The first ``limit`` pairs of each ``a``, which its task keeps before they are shuffled: all its pairs lie in it."""
        if limit is None:
            return self
        w = Window.partitionBy("a").orderBy(*order)
        return self._replace(pairs=self.pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r"))

    def named(self, a: str, b: str) -> DataFrame:
        """The pairs by uids, in columns ``a`` and ``b``."""
        numbers = F.broadcast(self.numbers) if self.n <= store.BROADCAST_ROWS else self.numbers
        out = self.pairs
        for old, new in (("a", a), ("b", b)):
            out = out.join(numbers.select(F.col("n").alias(old), F.col("uid").alias(new)), old).drop(old)
        return out.select(a, b, *[c for c in out.columns if c not in (a, b)])


def _union(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else _union([parts[0].unionByName(parts[1]), *parts[2:]])


def counted(kinds: dict[str, Kind], ordered: bool = False, most: tuple[dict[str, int], int] | None = None) -> Counted:
    """Of each two companies that share anything, how many keys of each kind, thirds where a kind has them.

    ``ordered``: only pairs whose first uid is the smaller one, else both ways. At most one kind may have thirds.
    ``most``: of each first company only so many pairs, those of the highest sum of counts by weights of kinds, ties to the
    smaller uid; they are picked where they are counted, so the others never leave their task."""
    rows = [m.toDF("company", "key").filter("company is not null and key is not null") for k in kinds.values() for m in k[:3] if m is not None]
    numbers = store.numbered(_union([m.select(F.col("company").alias("uid")) for m in rows]).distinct(), F.col("uid")).select("uid", F.col("n").cast("int").alias("n"))
    numbers = stored(numbers, "numbers")
    n = numbers.count()
    known = F.broadcast(numbers) if n <= store.BROADCAST_ROWS else numbers

    def listed(members: DataFrame, name: str, edges: bool = False) -> DataFrame:
        m = members.toDF("uid", "key").join(known, "uid").filter("key is not null")
        return m.groupBy("key").agg((F.collect_list if edges else F.collect_set)("n").alias(name))

    none, parts, third, far = F.array().cast("array<int>"), [], None, None
    for i, (name, kind) in enumerate(kinds.items()):
        out = listed(kind.first, "firsts", kind.edges)
        out = out.withColumn("seconds", F.col("firsts")) if kind.second is None else out.join(listed(kind.second, "seconds", kind.edges), "key")
        if kind.third is not None:
            third, far = name, kind.far  # a far kind's pairs have met on a key without any third as well
            out = out.join(listed(kind.third, "thirds"), "key", "inner" if far is None else "left").withColumn("thirds", F.coalesce("thirds", none))
        else:
            out = out.withColumn("thirds", none)
        several = "size(seconds) > 1 or firsts[0] <> seconds[0]"
        parts.append(out.filter(several).select(F.lit(i).alias("kind"), "firsts", "seconds", "thirds"))
    lists = stored(_union(parts), "lists")
    if far is not None:
        return Counted(_tiled(lists, far.toDF("uid", "third"), known, n, list(kinds), third), numbers, n)
    size = lambda c: F.size(c).cast("double")
    made = lists.agg(F.sum(size("firsts") * size("seconds") * F.greatest(F.lit(1.0), size("thirds"))).alias("n")).first().n or 0
    blocks = max(1, min(n, max(BLOCKS, int(made // BLOCK_ROWS))))
    block: Callable[[Column], Column] = lambda x: F.floor(x.cast("long") * blocks / F.lit(max(n, 1))).cast("int")
    laid = lists.select("*", F.explode(F.array_distinct(F.transform("firsts", block))).alias("block"))
    laid = laid.withColumn("firsts", F.filter("firsts", lambda x: block(x) == F.col("block"))).repartition(blocks, "block").sortWithinPartitions("block")
    names = list(kinds)
    schema = "a int, b int, " + ", ".join(f"{c} long" for c in names)
    out = laid.select("kind", "firsts", "seconds", "thirds", "block").mapInArrow(_counter(names, third, ordered, most, n, blocks), schema)
    return Counted(out, numbers, n)


SIDE = 2_048  # companies of a tile's side
_FAR_FIRST, _FAR_SECOND = -1, -2  # instead of a kind: a company's own thirds, as the first or the second of pairs


def _tiled(lists: DataFrame, far: DataFrame, known: DataFrame, n: int, names: list[str], third: str) -> DataFrame:
    """(a, b, counts..) with a < b of ``counted``'s lists, and common ``far`` thirds of pairs that have no key of ``third``.

    Any two companies may be such a pair, so they meet in tiles of ``SIDE`` by ``SIDE``, each one's counts in arrays of
    fixed size. A list goes to the tiles of its companies, a company's thirds to those of its row and column where the
    other side has blocks of thirds in common; pairs themselves are not shuffled."""
    side = max(1, min(SIDE, -(-n // 6)))
    count = max(1, -(-n // side))
    block: Callable[[str | Column], Column] = lambda x: F.floor((F.col(x) if isinstance(x, str) else x) / F.lit(side)).cast("int")
    blocks: Callable[[str], Column] = lambda c: F.array_distinct(F.transform(c, block))
    tiles = F.flatten(F.transform(blocks("firsts"), lambda i: F.transform(F.filter(blocks("seconds"), lambda j: j >= i), lambda j: i * F.lit(count) + j)))
    laid = lists.select("*", F.explode(tiles).alias("tile"))
    laid = laid.withColumn("firsts", F.filter("firsts", lambda x: block(x) == F.floor(F.col("tile") / F.lit(count)))).withColumn("seconds", F.filter("seconds", lambda x: block(x) == F.col("tile") % F.lit(count)))
    number = lambda c: known.select(F.col("uid").alias(c), F.col("n").alias(f"{c}_n"))
    own = far.filter("uid is not null and third is not null").join(number("uid"), "uid").join(number("third"), "third")
    own = stored(own.groupBy(F.col("uid_n").alias("n")).agg(F.collect_set("third_n").alias("thirds")).withColumn("block", block("n")), "far")
    has = stored(own.select("block", F.explode(blocks("thirds")).alias("at")).distinct(), "far-blocks")
    met = stored(has.withColumnRenamed("block", "i").join(has.withColumnRenamed("block", "j"), "at").filter("i <= j").select("i", "j").distinct(), "far-tiles")
    met = met.withColumn("tile", F.col("i") * F.lit(count) + F.col("j"))
    none, one = F.array().cast("array<int>"), F.array("n")
    rows = F.broadcast(met.groupBy(F.col("i").alias("block")).agg(F.collect_list("tile").alias("tiles")))
    columns = F.broadcast(met.groupBy(F.col("j").alias("block")).agg(F.collect_list("tile").alias("tiles")))
    first = own.join(rows, "block").select(F.lit(_FAR_FIRST).alias("kind"), one.alias("firsts"), none.alias("seconds"), "thirds", F.explode("tiles").alias("tile"))
    second = own.join(columns, "block").select(F.lit(_FAR_SECOND).alias("kind"), none.alias("firsts"), one.alias("seconds"), "thirds", F.explode("tiles").alias("tile"))
    cells = laid.select("kind", "firsts", "seconds", "thirds", "tile").unionByName(first).unionByName(second)
    cells = cells.repartition(min(10_000, count * (count + 1) // 2), "tile").sortWithinPartitions("tile")
    return cells.mapInArrow(_tile_counter(names, third, side, count), "a int, b int, " + ", ".join(f"{c} long" for c in names))


COLUMNS = 4_096  # thirds that a tile's product looks at at once


def _common(mine: list[tuple[int, np.ndarray]], theirs: list[tuple[int, np.ndarray]], side: int) -> np.ndarray:
    """How many values each of ``mine`` has in common with each of ``theirs``, both (place, distinct values)."""
    out = np.zeros((side, side), "float32")
    if not mine or not theirs:
        return out
    sides = []
    for rows in (mine, theirs):
        at = np.repeat(np.array([i for i, _ in rows], "int64"), [len(v) for _, v in rows])
        sides.append((at, np.concatenate([v for _, v in rows])))
    shared = np.intersect1d(sides[0][1], sides[1][1])
    entries = []
    for at, values in sides:
        column = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        keep = shared[column] == values if len(shared) else np.zeros(len(values), bool)
        at, column = at[keep], column[keep]
        order = np.argsort(column, kind="stable")
        entries.append((at[order], column[order]))
    for start in range(0, len(shared), COLUMNS):
        parts = []
        for at, column in entries:
            lo, hi = np.searchsorted(column, [start, start + COLUMNS])
            m = np.zeros((side, min(COLUMNS, len(shared) - start)), "float32")
            m[at[lo:hi], column[lo:hi] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T  # whole numbers below 2^24 stay exact
    return out


def _tile_counter(names: list[str], third: str, side: int, count: int) -> Callable:
    """Counts the pairs of one tile after the other; what it holds are a tile's counts, and distinct thirds of its pairs."""
    which = names.index(third)

    class Tile:
        def __init__(self, tile: int) -> None:
            self.i, self.j = tile // count * side, tile % count * side
            self.same = self.i == self.j
            self.counts = [np.zeros(side * side, "int32") if i != which else None for i in range(len(names))]
            self.met = np.zeros(side * side, bool)
            self.near, self.waiting = np.empty(0, "int64"), []
            self.own: dict[int, list] = {_FAR_FIRST: [], _FAR_SECOND: []}

        def merge(self) -> None:
            self.near, self.waiting = np.unique(np.concatenate([self.near, *self.waiting])), []

        def add(self, kind: np.ndarray, firsts: tuple, seconds: tuple, thirds: tuple) -> None:
            for r in np.flatnonzero(kind < 0):
                n = firsts[0][firsts[1][r]] - self.i if kind[r] == _FAR_FIRST else seconds[0][seconds[1][r]] - self.j
                self.own[int(kind[r])].append((int(n), thirds[0][thirds[1][r] : thirds[1][r + 1]].copy()))
            for a, b, r in _made(firsts, seconds, True):
                code = (a.astype("int64") - self.i) * side + (b - self.j)
                for i in range(len(names)):
                    mine = kind[r] == i
                    if i != which:
                        np.add.at(self.counts[i], code[mine], 1)
                        continue
                    pairs, at_row = code[mine], r[mine]
                    self.met[pairs] = True
                    for part, n in _steps(np.diff(thirds[1])[at_row]):
                        p, c, _ = _crossed(pairs[part], at_row[part], n, *thirds)
                        other = (c != p // side + self.i) & (c != p % side + self.j)
                        self.waiting.append(np.unique((p[other] << 32) | c[other]))
                        if sum(map(len, self.waiting)) > max(2 * STEP, len(self.near)):
                            self.merge()

        def result(self) -> Iterator[pa.RecordBatch]:
            self.merge()
            n = _common(self.own[_FAR_FIRST], self.own[_FAR_SECOND], side).astype("int32")
            n = (np.triu(n, 1) if self.same else n).reshape(-1)
            n[self.met] = 0
            n += np.bincount(self.near >> 32, minlength=side * side).astype("int32")
            self.counts[which] = n
            codes = np.flatnonzero(np.logical_or.reduce([c > 0 for c in self.counts]))
            for start in range(0, len(codes), 100_000):
                part = codes[start : start + 100_000]
                columns = [(part // side + self.i).astype("int32"), (part % side + self.j).astype("int32"), *[c[part].astype("int64") for c in self.counts]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", *names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = now = None
        for tile, *rows in _runs(batches, 4):
            if current != tile:
                if now is not None:
                    yield from now.result()
                current = now = None
                current, now = tile, Tile(tile)
            now.add(rows[0], *rows[1])
        if now is not None:
            yield from now.result()

    return run


STEP = 2_000_000  # pairs that a task makes at once
CELLS = 50_000_000  # counts that a block may hold as one array: of its companies with all others, for each kind

Lists = tuple[np.ndarray, np.ndarray]  # values, and where each row's begin


def _runs(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[int, np.ndarray, tuple[Lists, Lists, Lists]]]:
    """A column's value, and kinds and lists of the rows that follow each other with it."""
    for batch in batches:
        keys = batch.column(column).to_numpy()
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.empty(0, "int64")
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = batch.slice(lo, hi - lo)
            yield int(keys[lo]), part.column(0).to_numpy(), tuple(_flat(part.column(k)) for k in (1, 2, 3))


class _Sorted:
    """Counts of one block by sorting: what it holds are its distinct pairs, and distinct thirds of each."""

    def __init__(self, names: list[str], third: str | None, ordered: bool, most: tuple[dict[str, int], int] | None) -> None:
        self.names, self.third, self.ordered, self.most = names, third, ordered, most
        self.state = [(np.empty(0, "int64"), np.empty(0, "int64")) for _ in names]  # of a kind: pairs and counts, or pairs and thirds
        self.waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]

    def _merge(self, i: int) -> None:
        codes = np.concatenate([self.state[i][0], *[w[0] for w in self.waiting[i]]])
        values = np.concatenate([self.state[i][1], *[w[1] for w in self.waiting[i]]])
        self.waiting[i] = []
        if self.names[i] == self.third:
            order = np.lexsort((values, codes))
            codes, values = codes[order], values[order]
            new = np.ones(len(codes), bool)
            new[1:] = (codes[1:] != codes[:-1]) | (values[1:] != values[:-1])
            self.state[i] = codes[new], values[new]
        else:
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, "int64")
            self.state[i] = codes[starts], np.add.reduceat(values, starts) if len(codes) else values

    def _add(self, i: int, codes: np.ndarray, values: np.ndarray) -> None:
        self.waiting[i].append((codes, values))
        if sum(len(w[0]) for w in self.waiting[i]) > max(2 * STEP, len(self.state[i][0])):
            self._merge(i)

    def add(self, kind: np.ndarray, firsts: Lists, seconds: Lists, thirds: Lists) -> None:
        for a, b, r in _made(firsts, seconds, self.ordered):
            code = (a.astype("int64") << 32) | b
            for i, name in enumerate(self.names):
                mine = kind[r] == i
                if not mine.any():
                    continue
                if name != self.third:
                    self._add(i, *np.unique(code[mine], return_counts=True))
                    continue
                pairs, at_row = code[mine], r[mine]
                for part, n in _steps(np.diff(thirds[1])[at_row]):
                    p, c, _ = _crossed(pairs[part], at_row[part], n, *thirds)
                    other = (c != p >> 32) & (c != p & 0xFFFFFFFF)
                    self._add(i, p[other], c[other].astype("int64"))

    def result(self) -> Iterator[pa.RecordBatch]:
        counts = []
        for i, name in enumerate(self.names):
            self._merge(i)
            counts.append(np.unique(self.state[i][0], return_counts=True) if name == self.third else self.state[i])
            self.state[i] = None
        codes = np.unique(np.concatenate([c for c, _ in counts]))
        if self.most is not None and len(codes):
            weights, limit = self.most
            score = np.zeros(len(codes), "int64")
            for name, (known, n) in zip(self.names, counts):
                score[np.searchsorted(codes, known)] += weights.get(name, 0) * n
            codes = codes[_most(codes >> 32, score, limit)]
        for start in range(0, len(codes), 100_000):
            part = codes[start : start + 100_000]
            columns = [(part >> 32).astype("int32"), (part & 0xFFFFFFFF).astype("int32")]
            for known, n in counts:
                at = np.minimum(np.searchsorted(known, part), max(len(known) - 1, 0))
                columns.append(np.where(known[at] == part, n[at], 0) if len(known) else np.zeros(len(part), "int64"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", *self.names])


class _Dense:
    """Counts of one block, whose first companies are ``lo`` up to ``hi``, as an array of each kind: nothing is sorted."""

    def __init__(self, names: list[str], ordered: bool, most: tuple[dict[str, int], int] | None, lo: int, hi: int, n: int) -> None:
        self.names, self.ordered, self.most, self.lo, self.n = names, ordered, most, lo, n
        self.counts = [np.zeros((hi - lo) * n, "int32") for _ in names]

    def add(self, kind: np.ndarray, firsts: Lists, seconds: Lists, thirds: Lists) -> None:
        for a, b, r in _made(firsts, seconds, self.ordered):
            code = (a.astype("int64") - self.lo) * self.n + b
            for i in range(len(self.names)):
                np.add.at(self.counts[i], code[kind[r] == i], 1)

    def result(self) -> Iterator[pa.RecordBatch]:
        rows = max(1, STEP // self.n)
        for start in range(0, len(self.counts[0]), rows * self.n):
            counts = [c[start : start + rows * self.n] for c in self.counts]
            codes = np.flatnonzero(np.logical_or.reduce([c > 0 for c in counts]))
            if self.most is not None and len(codes):
                weights, limit = self.most
                score = sum(weights.get(name, 0) * c[codes].astype("int64") for name, c in zip(self.names, counts))
                codes = codes[_most(codes // self.n, score, limit)]
            for at in range(0, len(codes), 100_000):
                part = codes[at : at + 100_000]
                columns = [((start + part) // self.n + self.lo).astype("int32"), (part % self.n).astype("int32"), *[c[part].astype("int64") for c in counts]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", *self.names])


def _made(firsts: Lists, seconds: Lists, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of each row's first and second companies, and the row, in steps."""
    row = np.repeat(np.arange(len(firsts[1]) - 1), np.diff(firsts[1]))  # of each first company
    for at, size in _steps(np.diff(seconds[1])[row]):
        a, b, r = _crossed(firsts[0][at], row[at], size, *seconds)
        keep = a < b if ordered else a != b
        yield a[keep], b[keep], r[keep]


def _counter(names: list[str], third: str | None, ordered: bool, most: tuple[dict[str, int], int] | None, n: int, blocks: int) -> Callable:
    """Counts the pairs of a partition's lists, one block after the other."""

    def block(number: int) -> _Sorted | _Dense:
        lo, hi = (-(-x * n // blocks) for x in (number, number + 1))
        return _Dense(names, ordered, most, lo, hi, n) if third is None and (hi - lo) * n * len(names) <= CELLS else _Sorted(names, third, ordered, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = now = None
        for number, *rows in _runs(batches, 4):
            if number != current:
                if now is not None:
                    yield from now.result()
                current = now = None  # its arrays go before the next one's come
                current, now = number, block(number)
            now.add(rows[0], *rows[1])
        if now is not None:
            yield from now.result()

    return run


def _most(first: np.ndarray, score: np.ndarray, limit: int) -> np.ndarray:
    """Where the ``limit`` highest scores of each first company are, in the order of pairs; ``first`` ascends, and ties go to the earlier pair."""
    order = np.lexsort((-score, first))
    starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    rank = np.arange(len(first)) - np.repeat(starts, np.diff(np.r_[starts, len(first)]))
    return np.sort(order[rank < limit])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the offsets of its rows in them."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _steps(sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of rows that are crossed with so many values each, of ``STEP`` results or one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + STEP, "right")))
        yield slice(start, stop), sizes[start:stop]
        start = stop


def _crossed(x: np.ndarray, row: np.ndarray, size: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each of ``x`` with each value of its row: both, and the row."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[row] - (ends - size), size)
    return np.repeat(x, size), values[at], np.repeat(row, size)
