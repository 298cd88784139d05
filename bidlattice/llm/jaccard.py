"""N-gram Jaccard join: signature trees of token bitmaps over candidate groups name pairs, which are compared in place; links make components."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import dropped, prepare, stored
from . import words

SHINGLE, SIMILARITY = 5, (80, 100)  # unless a caller says otherwise
SPARE = 12  # one more key for each so many elements: linked sets then share more keys, and sets that share fewer, by chance, have no link
FREQUENT = 1 << 18  # elements, at most, that are known as frequent and come last in the order of elements
SEEN = 4  # sets of a slice that must have an element for it to be counted
CHUNK = 512  # sets of one tree
CHUNK_ELEMENTS = 1 << 20  # and their elements together
BROADCAST_ROWS = 1_000_000  # pairs of integers that a broadcast may hold; beyond it both sides are shuffled
IN_PLACE = 1  # rounds in which each set stands in one group alone
FAN = 4  # children of a tree's node
BITS = (6, 15)  # powers of two: least and most bits of a tree's bitmaps
BITS_EACH = 4  # bits or more that a stored bitmap has for each element
AT_ONCE = 256  # pairs compared before those that have come into one component are passed over
_LAST = 2**63 - 1


class Likeness(NamedTuple):
    """Sets of sizes a and b with i in common are linked where (num + den) * i >= num * (a + b), that is Jaccard >= num / den."""

    num: int
    den: int

    def linked(self, a, b, common):
        return (self.num + self.den) * common >= self.num * (a + b)

    def least(self, size):
        """The fewest elements that a set shares with one it is linked with, and the smallest size of such a set."""
        return -(-size * self.num // self.den)

    def lead(self, size):
        """How many keys a set of this size shares at least with a linked one that is not smaller."""
        return np.minimum(1 + size // SPARE, self.least(size))

    def keys(self, size):
        """How many of a set's first elements, in one order for all sets, are its keys.

        Linked sets have ``least`` elements in common or more, so of the first common ones, as many as the smaller
        lead, none has more than size - least others before it: each is a key of both."""
        return size - self.least(size) + self.lead(size)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles of one text, or its whole word sequence if that is shorter; sorted hashes."""
    n = len(hashes)
    return np.unique(words.grams(hashes, min(k, n))) if n else np.zeros(0, np.uint64)


class Sets(NamedTuple):
    """The sets of one slice of texts: all their elements, n + 1 bounds, each set's id (a hash of its elements)."""

    slice: words.Text
    elements: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def of(self, row: int) -> np.ndarray:
        return self.elements[self.bounds[row] : self.bounds[row + 1]]

    def column(self) -> pa.Array:
        """The ids, null without words."""
        return pa.array(self.ids, mask=self.sizes() == 0)

    def distinct(self) -> np.ndarray:
        """The first row of each set that is not empty."""
        rows = np.flatnonzero(self.sizes())
        return rows[np.sort(np.unique(self.ids[rows], return_index=True)[1])]


def _sets(batches, k: int):
    for s in words.slices(batches):
        w = words.words(s.data, s.offsets, words.NON_SPACE, lower=True)
        h = words.word_digests(w)[:, 0]
        g = words.grams(h, k)
        own = [np.unique(g[a : b - k + 1]) if b - a >= k else shingles(h[a:b], k) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
        bounds = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int64)
        elements = np.concatenate(own) if own else np.zeros(0, np.uint64)
        total = np.append(np.uint64(0), np.cumsum(words.mix(elements), dtype=np.uint64))
        yield Sets(s, elements, bounds, (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))


_BASE = "doc_id long, n_shingles long, set long, element long, seen long"


def _base(k: int):
    """A row for each text, and (element, seen) of elements that SEEN sets of a slice have."""

    def run(batches):
        for x in _sets(batches, k):
            rows = x.distinct()
            found, seen = np.unique(np.concatenate([x.of(r) for r in rows.tolist()]) if len(rows) else np.zeros(0, np.uint64), return_counts=True)
            often = seen >= SEEN
            found, seen = found[often].view(np.int64), seen[often]
            n, m = len(x.ids), len(found)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.slice.ids, pa.nulls(m, x.slice.ids.type)]), pa.concat_arrays([pa.array(x.sizes()), pa.nulls(m, pa.int64())]), pa.concat_arrays([x.column(), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(found)]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(seen)])], ["doc_id", "n_shingles", "set", "element", "seen"])

    return run


def _frequent(base: DataFrame) -> np.ndarray:
    """The most frequent elements, rarest first. They only set the order of elements: any order finds the same links, and
    with frequent ones last few sets share a key that are not alike."""
    found = base.filter("seen is not null").groupBy("element").agg(F.sum("seen").alias("n")).orderBy(F.desc("n"), "element").limit(FREQUENT)
    return found.select("element").toArrow()["element"].to_numpy()[::-1].view(np.uint64)


def keys(elements: np.ndarray, bounds: np.ndarray, like: Likeness, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each set, its first elements in the order (frequent or not, how frequent, hash), and their places' sets."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.zeros(len(elements), np.int64)
    if len(frequent):
        order = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent, elements, sorter=order), len(frequent) - 1)
        rank = np.where(frequent[order[at]] == elements, order[at] + 1, 0)
    late = np.flatnonzero(np.bincount(row[rank > 0], minlength=len(sizes)))  # elements come sorted by hash: other sets are in order
    place = np.arange(len(elements)) - np.repeat(bounds[:-1], sizes)
    for r in late.tolist():
        a, b = bounds[r], bounds[r + 1]
        place[a + np.argsort(rank[a:b], kind="stable")] = np.arange(b - a)
    use = place < np.repeat(like.keys(sizes), sizes)
    return elements[use], row[use]


def _keyed(k: int, like: Likeness, frequent):
    """(key, set, n): each distinct set of a slice of texts once."""

    def run(batches):
        last = frequent.value
        for x in _sets(batches, k):
            rows = x.distinct()
            if not len(rows):
                continue
            sizes = x.sizes()[rows]
            key, row = keys(np.concatenate([x.of(r) for r in rows.tolist()]), np.append(0, np.cumsum(sizes)), like, last)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x.ids[rows][row]), pa.array(sizes[row].astype(np.int32))], ["key", "set", "n"])

    return run


def _content(k: int):
    """(set, n, map, elements) of texts that stand for their set (rows carry the set's id as ``want``)."""

    def run(batches):
        for x in _sets(batches, k):
            want = x.slice.rows.column("want").to_numpy()
            rows = np.flatnonzero((want == x.ids) & (x.sizes() > 0)).tolist()
            maps = [bitmap(x.of(r), 1 << max(BITS[0], math.ceil(math.log2(BITS_EACH * len(x.of(r)))))).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[rows]), pa.array(x.sizes()[rows]), pa.array(maps, pa.binary()), pa.array([x.of(r).tobytes() for r in rows], pa.binary())], ["set", "n", "map", "elements"])

    return run


def bitmap(elements: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each element, as 64-bit words; the map of half as many words is the OR of its halves."""
    h = words.mix(elements)
    out = np.zeros(bits, np.uint8)
    out[((h & np.uint64((bits >> 6) - 1)) * np.uint64(64) + (h >> np.uint64(58))).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def fitted(maps: list[np.ndarray], sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maps brought to one length, and for each set how many of its elements at most have no bit of their own.

    A longer map is folded; a shorter one is repeated, so that it has each element's bit wherever that may be."""
    own = [np.bitwise_or.reduce(m.reshape(-1, length), 0) if len(m) > length else m for m in maps]
    excess = sizes - np.array([int(np.bitwise_count(m).sum()) for m in own])
    return np.array([np.tile(m, length // len(m)) for m in own]), excess


def small(df: DataFrame) -> DataFrame:
    """``df``, integers that are stored, marked for broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Level(NamedTuple):
    """Nodes of one level of a signature tree: OR of bitmaps, size range, most elements beyond bits, component or -1."""

    maps: np.ndarray
    low: np.ndarray
    high: np.ndarray
    excess: np.ndarray
    component: np.ndarray


def tree(maps: np.ndarray, sizes: np.ndarray, excess: np.ndarray, components: np.ndarray) -> list[Level]:
    """Levels from the leaves (one set each, in the order given) to one root."""
    levels = [Level(maps, sizes, sizes, excess, components)]
    while len(levels[-1].low) > 1:
        x = levels[-1]
        at = np.arange(0, len(x.low), FAN)
        same = np.minimum.reduceat(x.component, at)
        same[same != np.maximum.reduceat(x.component, at)] = -1
        levels.append(Level(np.bitwise_or.reduceat(x.maps, at), np.minimum.reduceat(x.low, at), np.maximum.reduceat(x.high, at), np.maximum.reduceat(x.excess, at), same))
    return levels


def traverse(a: list[Level], b: list[Level], like: Likeness, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs that may be linked, and their largest possible overlap, from a dual traversal of two trees of equal
    height, or of one with itself.

    A node pair goes on only if the largest overlap that sizes and bitmaps allow could link some pair of its sets, and
    if its sets are not all of one component."""
    i = j = np.zeros(1, np.int64)
    for depth in range(len(a) - 1, -1, -1):
        x, y = a[depth], b[depth]
        if depth < len(a) - 1:
            k = np.arange(FAN * FAN)
            i, j = (i[:, None] * FAN + k // FAN).ravel(), (j[:, None] * FAN + k % FAN).ravel()
            ok = (i < len(x.low)) & (j < len(y.low))
            if itself:
                ok &= i <= j
            i, j = i[ok], j[ok]
        if itself and not depth:
            i, j = i[i != j], j[i != j]
        ok = (x.component[i] != y.component[j]) | (x.component[i] < 0)
        i, j = i[ok], j[ok]
        most = np.minimum(x.high[i], y.high[j])
        ok = like.linked(x.low[i], y.low[j], most)
        i, j, most = i[ok], j[ok], most[ok]
        for lo in range(0, len(i), 2048):
            p, q = i[lo : lo + 2048], j[lo : lo + 2048]
            bits = np.bitwise_count(x.maps[p] & y.maps[q]).sum(1, dtype=np.int64) + np.minimum(x.excess[p], y.excess[q])
            most[lo : lo + 2048] = np.minimum(most[lo : lo + 2048], bits)
        ok = like.linked(x.low[i], y.low[j], most)
        i, j, most = i[ok], j[ok], most[ok]
    return i, j, most


def _level_up(levels: list[Level], height: int) -> list[Level]:
    while len(levels) < height:
        levels = [*levels, levels[-1]]
    return levels


def candidates(maps: list[np.ndarray], sizes: np.ndarray, root: np.ndarray, side: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that the trees of these sets can't rule out, those of largest possible overlap first.

    Pairs are of all sets, or of sides 0 and 1 if there are both, and of different components (``root``)."""
    length = 1 << min(max(math.ceil(math.log2(8 * max(float(np.median(sizes)), 1))), BITS[0]), BITS[1]) >> 6
    order = np.lexsort((root, sizes))
    maps, excess = fitted([maps[i] for i in order.tolist()], sizes[order], min(length, max(len(m) for m in maps)))
    leaves = (maps, sizes[order], excess, root[order])
    if (side == side[0]).all():
        x = tree(*leaves)
        i, j, most = traverse(x, x, like, True)
        i, j = order[i], order[j]
    else:
        halves = [np.flatnonzero(side[order] == k) for k in (0, 1)]
        x, y = (tree(*[c[h] for c in leaves]) for h in halves)
        height = max(len(x), len(y))
        i, j, most = traverse(_level_up(x, height), _level_up(y, height), like, False)
        i, j = order[halves[0][i]], order[halves[1][j]]
    best = np.argsort(-most / np.maximum(sizes[i], sizes[j]), kind="stable")
    return i[best], j[best]


def links(sets: list[np.ndarray], root: np.ndarray, i: np.ndarray, j: np.ndarray, like: Likeness) -> list[tuple[int, int]]:
    """Of the pairs i, j those that are linked, enough to join all that are: a pair in one component, given or found, is not compared."""
    root, out = root.copy(), []
    while len(i):
        for p, q in zip(i[:AT_ONCE].tolist(), j[:AT_ONCE].tolist(), strict=True):
            if root[p] == root[q]:
                continue
            x, y = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
            if like.linked(len(x), len(y), int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())):
                out.append((p, q))
                root[root == root[q]] = root[p]
        i, j = i[AT_ONCE:], j[AT_ONCE:]
        ok = root[i] != root[j]
        i, j = i[ok], j[ok]
    return out


def _trees(like: Likeness, compared: bool):
    """Rows of one group and chunk pair after another, in order; (a, b) of links, compared in place with the elements in
    the rows, or of pairs that may be linked, each named by the first alone of the groups that have both sets (``keys``)."""
    more = "elements" if compared else "keys"

    def run(batches):
        group, held = None, []

        def flush():
            ids, n, root, side = (np.array([r[k] for r in held], np.int64) for k in (0, 1, 2, 3))
            root = np.unique(root, return_inverse=True)[1]
            i, j = candidates([np.frombuffer(r[4], np.uint64) for r in held], n, root, side, like)
            if compared:
                found = links([np.frombuffer(r[5], np.uint64) for r in held], root, i, j, like)
            else:
                among = {p: set(held[p][5]) for p in np.unique(j).tolist()}
                found = [(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if next(k for k in held[p][5] if k in among[q]) == group[0]]
            a, b = ids[[p for p, _ in found]], ids[[q for _, q in found]]
            return pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("group", "i", "j", "set", "n", "component", "side", "map", more)], strict=True):
                if r[:3] != group:
                    if len(held) > 1:
                        yield flush()
                    group, held = r[:3], []
                held.append(r[3:])
        if len(held) > 1:
            yield flush()

    return run


def _searched(rows: DataFrame, content: DataFrame, like: Likeness, name: str, compared: bool) -> DataFrame:
    """The links, or the pairs that may be linked, (a, b) that the trees of ``rows`` (group, i, j, side, set, component[, keys]) find."""
    rows = rows.join(content.select("set", "n", "map", *["elements"] * compared), "set")
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "set")
    return stored(rows.mapInArrow(_trees(like, compared), "a long, b long").distinct(), name)


def _verify(like: Likeness):
    """Of rows (a, b, x, y) those whose sets x and y are linked."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(links([x, y], np.arange(2), np.zeros(1, int), np.ones(1, int), like)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compared(pairs: DataFrame, content: DataFrame, like: Likeness, name: str) -> DataFrame:
    """The linked ones of pairs (a, b), which are stored. Only their sets' elements move."""
    elements = lambda c, as_: content.select(F.col("set").alias(c), F.col("elements").alias(as_))
    half = stored(elements("b", "y").join(small(pairs), "b"), f"{name}-half")
    theirs = stored(pairs.select("a").distinct(), f"{name}-sets")
    both = half.join(elements("a", "x").join(small(theirs), "a", "left_semi"), "a").select("a", "b", "x", "y")
    out = stored(both.mapInArrow(_verify(like), "a long, b long"), name)
    dropped(half)
    return out


def _chunks() -> F.Column:
    return F.greatest(F.ceil(F.col("sets") / CHUNK), F.ceil(F.col("elements") / CHUNK_ELEMENTS), F.lit(1)).cast("int")


def _open_groups(members: DataFrame, roots: DataFrame | None, lead: F.Column) -> DataFrame:
    """(key, set, n, component, sets, elements) of groups that have sets of several components; of groups with the same
    sets one alone. Without ``roots``, of all groups: each set is a component.

    Sets that are linked share ``lead`` (n) keys. So each set leaves groups, those that stand for the fewest keys first in
    one order of all, as long as they stand for fewer keys than that together: the last group in that order that two
    linked sets share is one that both still have."""
    named = members.withColumn("component", F.col("set"))
    if roots is not None:
        named = stored(members.join(roots, "set", "left").select("key", "set", "n", F.coalesce("root", "set").alias("component")), "named")
    groups = stored(_alike(named).select("key", "sets", "keys"), "groups")
    order = Window.partitionBy("set").orderBy("keys", F.desc("sets"), "key")  # a set has no more groups than elements
    mine = named.join(groups, "key").withColumn("left", F.sum("keys").over(order)).filter(F.col("left") >= lead).select("key", "set", "n", "component")
    mine = stored(mine, "held")
    groups = _alike(mine).select("key", "sets", "elements")
    out = stored(mine.join(stored(groups, "sizes"), "key"), "open")
    for used in (mine, named) if roots is not None else (mine,):
        dropped(used)
    return out


def _alike(rows: DataFrame) -> DataFrame:
    """(key, sets, elements, keys) of groups of several components; groups with the same sets are one, which stands for several keys."""
    groups = rows.groupBy("key").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"), F.min("component").alias("c"), F.max("component").alias("d"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("who"))
    return groups.filter("c <> d").groupBy("sets", "elements", "who").agg(F.min("key").alias("key"), F.count("*").alias("keys"))


def _lead(like: Likeness) -> F.Column:
    """``Likeness.lead`` of the smallest set that one of size ``n`` can be linked with."""
    share = lambda c: F.ceil(c * F.lit(like.num) / F.lit(like.den)).cast("long")  # noqa: E731  exact for sizes below 2^53 / num
    least = share(F.col("n"))
    return F.least(F.lit(1) + F.floor(least / SPARE), share(least))


def _round_in_place(mine: DataFrame) -> DataFrame:
    """Rows for trees in which each set of open groups stands once, in the largest that it is a member of.

    A group of several chunks grows a tree for each; its smallest and largest sets, by id and by hash, stand in all of
    them, so that the chunks of one cluster come into one component without a comparison of chunk with chunk."""
    top = mine.groupBy("set").agg(F.max(F.struct("sets", "key", "n", "component")).alias("t")).select("set", "t.key", "t.n", "t.component")
    who = F.struct("set", "component")
    mixed = F.struct(F.xxhash64("set").alias("h"), who.alias("who"))
    groups = top.groupBy("key").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"), F.array(F.min(who), F.max(who), F.min(mixed)["who"], F.max(mixed)["who"]).alias("pivots"))
    groups = stored(groups.filter("sets > 1").select("key", _chunks().alias("chunks"), "pivots"), "place-groups")
    own = top.join(groups.select("key", "chunks"), "key").select(F.col("key").alias("group"), F.pmod(F.xxhash64("set", F.lit(7)), F.col("chunks")).cast("int").alias("i"), "set", "component")
    everywhere = groups.filter("chunks > 1").select(F.col("key").alias("group"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), "pivots").withColumn("p", F.explode("pivots")).select("group", "i", "p.set", "p.component")
    rows = own.unionByName(everywhere).distinct()
    return small(stored(rows.select("group", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "set", "component"), "place-rows"))


def _last_round(mine: DataFrame) -> DataFrame:
    """Rows for trees over all open groups, in pairs of chunks. A group goes if one other group has all its sets: that is
    seen where the largest group of each of its sets is the same."""
    top = stored(mine.groupBy("set").agg(F.max(F.struct("sets", "key")).alias("t")).select("set", F.col("t.key").alias("top")), "tops")
    stays = mine.join(top, "set").groupBy("key").agg(F.min("top").alias("a"), F.max("top").alias("b")).filter("a <> b or a = key").select("key")
    mine = stored(mine.join(stored(stays, "stays"), "key"), "staying")
    mine = mine.join(mine.groupBy("set").agg(F.sort_array(F.collect_list("key")).alias("keys")), "set")  # no more than the set has elements
    mine = mine.withColumn("chunks", _chunks()).withColumn("chunk", F.pmod(F.xxhash64("set", F.lit(7)), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j"), F.when(o < F.col("chunk"), 1).otherwise(0).alias("side")))
    few = mine.filter("chunks = 1").select(F.col("key").alias("group"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "set", "component", "keys")
    many = mine.filter("chunks > 1").withColumn("pair", F.explode(pairs)).select(F.col("key").alias("group"), "pair.*", "set", "component", "keys")
    return few.unionByName(many)


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """(set, root) of each linked set: root is the smallest id it reaches.

    Alternates large-star and small-star steps until nothing changes, and stores the edges after each round. Minima meet
    the edges by broadcast while there are at most BROADCAST_ROWS edges; beyond that both are stored and shuffled, so
    that a set with very many links is split."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    before = None
    while True:
        few = edges.count() <= BROADCAST_ROWS
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(F.broadcast(least) if few else stored(least, name), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large if few else stored(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        least = least if few else stored(least, name)
        small = large.join(F.broadcast(least) if few else least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("set"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("set"), F.col("v").alias("root")))
        before = now


def join(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: links are pairs of different sets of shingles whose Jaccard
    similarity is at least num / den; component_id is the smallest doc_id reached by links or equal sets.

    1. Equal sets become one (their hash). 2. A set's keys are its first elements in one order of all, frequent ones
    last; linked sets share keys, in number. Keys of one set only fall away before anything else moves, and so do sets
    that share fewer keys than linked ones do. The sets with a key are a candidate group. 3. Groups grow signature
    trees, in chunks; a dual traversal names the pairs that can be linked. In the first IN_PLACE rounds each set stands in
    its largest group alone, its pairs are compared in place, and the links found make components; a group whose sets
    are all of one component has no more to tell. 4. The last round grows trees of all groups that still have sets of
    several components, and passes over pairs of one component; its rows hold bitmaps alone, and the pairs that no tree
    rules out, each named once, are compared after. 5. All links make the final components.
    No link between components is lost, no group is expanded into pairs or held as a whole, and the number of links of
    a document is not counted, as pairs inside a component are not compared.
    Null, empty and word-less texts have 0 shingles and are linked with nothing; null ids count as the largest, and
    a component of null ids alone has a null id. Rows that share an id are rows of their own."""
    return grouped(docs, shingle, similarity, doc_id, text).drop("set", "root")


def with_set(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text and any others) with each text's set as in ``grouped``; null where it has no words."""

    def run(batches):
        for x in _sets(batches, shingle):
            yield x.slice.rows.append_column("set", x.column())

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("set", T.LongType())]))


def shared(keyed: DataFrame) -> DataFrame:
    """The rows (key, set, n) whose key several sets have. They are dealt by the key once, and told where they lie."""
    key = Window.partitionBy("key")
    return keyed.withColumns({"a": F.min("set").over(key), "b": F.max("set").over(key)}).filter("a <> b").select("key", "set", "n")


def _members(texts: DataFrame, base: DataFrame, shingle: int, like: Likeness) -> DataFrame:
    """(key, set, n), stored, of keys that several sets have, and sets that share as many keys as linked sets do; a few keys may be
    left that one of these sets alone has, which make no group."""
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(base))
    keyed = stored(texts.mapInArrow(_keyed(shingle, like, frequent), "key long, set long, n int"), "keyed")
    members = stored(shared(keyed).distinct(), "shared")
    dropped(keyed)
    enough = stored(members.groupBy("set", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= _lead(like)).select("set"), "enough")
    fewer = stored(members.join(small(enough), "set").select("key", "set", "n"), "candidates")
    dropped(members)
    return fewer


def _read(texts: DataFrame, stand: DataFrame, sets: DataFrame, shingle: int, repeats: bool) -> DataFrame:
    """(set, n, map, elements) of the given sets, read again from one text of each; other texts are filtered before any Python."""
    wanted = stored(sets.distinct().join(stand, "set").select("doc", F.col("set").alias("want")), "wanted")
    found = texts.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))).join(small(wanted), "doc").select("doc_id", "text", "want").mapInArrow(_content(shingle), "set long, n long, map binary, elements binary")
    return stored(found.dropDuplicates(["set"]) if repeats else found, "content")


def grouped(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``join``, with each row's set and the component's name among sets (root), both null without words."""
    prepare(docs.sparkSession)
    like = Likeness(*similarity)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    both = stored(texts.mapInArrow(_base(shingle), _BASE), "sets")
    base = both.filter("seen is null").select("doc_id", "n_shingles", "set")
    members = _members(texts, both, shingle, like)
    return joined(texts, base, members, shingle, like, _lead(like))


def joined(texts: DataFrame, base: DataFrame, members: DataFrame, shingle: int, like: Likeness, lead: F.Column) -> DataFrame:
    """``base`` (doc_id, n_shingles, set), stored, with component_id and root, from the candidate groups of ``members`` (key, set, n),
    where linked sets share at least ``lead`` keys."""
    stand = stored(base.filter("set is not null").groupBy("set").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("doc")), "stand")
    repeats = base.count() > base.select("doc_id").distinct().count()
    opened = _open_groups(members, None, lead)
    sets = stored(opened.select("set").distinct(), "sets-in-groups")  # linked sets share a group; all others have no link
    content = _read(texts, stand, sets, shingle, repeats)
    members = stored(members.join(small(sets), "set"), "members-in-groups")
    known = lambda r: r.select(F.col("set").alias("a"), F.col("root").alias("b"))
    roots = None
    for _ in range(IN_PLACE):
        found = _searched(_round_in_place(opened), content, like, "links", True)
        roots = stored(components(found if roots is None else found.unionByName(known(roots))), "roots")
        opened = _open_groups(members, roots, lead)
    likely = _searched(_last_round(opened), content, like, "likely", False)
    roots = stored(components(_compared(likely, content, like, "last-links").unionByName(known(roots))), "roots")
    dropped(content)

    named = stored(roots.join(stand, "set").select("set", "root", "doc"), "named")
    smallest = stored(named.groupBy("root").agg(F.min("doc").alias("least")), "smallest")
    linked = named.join(smallest, "root").select("set", "root", "least")
    alone = stand.join(named.select("set"), "set", "left_anti").select("set", F.col("set").alias("root"), F.col("doc").alias("least"))
    out = base.join(stored(linked.unionByName(alone), "found"), "set", "left")
    component = F.when(F.col("least") == _LAST, F.lit(None).cast("long")).otherwise(F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "set", "root")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (90, 100))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i : i + k - 1], ' ') as t from (select doc_id, w, least(3, len(w)) as k, unnest(range(1, len(w) - least(3, len(w)) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
reach(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, link.y from reach r join link on link.x = r.other)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(other) from reach r where r.doc_id = d.doc_id) as component_id from d left join n on n.doc_id = d.doc_id
"""
