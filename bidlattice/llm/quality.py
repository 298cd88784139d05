"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then score together."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, prepare, stored
from . import words

LABELLED = 8000  # labelled rows that are fitted on, at most
POOL = 4000  # rows with pseudo-labels in a round, at most: a quarter for each view and class
HOLD_OUT = 0.25  # of the labelled rows of each class, for calibration
FEW = 200  # rows of a class, below which calibration is by cross-fitting
FOLDS = 5
ROUNDS = 3
CONFIDENT = 0.98  # calibrated probability of a class from which a view hands a pseudo-label to the other
PSEUDO_WEIGHT = 0.5
BUCKETS = 1 << 20  # of hashed text features
CHOSEN = 256  # text features that tell a target's classes apart best
META_BUCKETS = 256
REJECT = 0.5
#: What is rejected, by the columns of ``labels``.
TARGETS = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
_NUMBERS = 6


def text_features(s: words.Words, raw: np.ndarray, offsets: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the set of hashed features (sorted (text, bucket) codes as two arrays) and numbers about its form.

    Features are its lower-cased words, their first four and five and last two and three bytes; with
    ``use``, a mask of buckets, those in it alone."""
    n = len(offsets) - 1
    whole = words.word_hashes(s)
    parts = [whole]
    parts += [words.word_hashes(s._replace(ends=np.minimum(s.ends, s.starts + k))) + np.uint64(k) for k in (4, 5)]
    parts += [words.word_hashes(s._replace(starts=np.maximum(s.starts, s.ends - k))) + np.uint64(k << 8) for k in (2, 3)]
    text = np.repeat(np.arange(n), np.diff(s.bounds))
    found = []
    for p in parts:
        bucket = (words.mix(p) % np.uint64(BUCKETS)).astype(np.int64)
        at = slice(None) if use is None else use[bucket]
        found.append(text[at] * BUCKETS + bucket[at])
    codes = np.unique(np.concatenate(found)) if len(whole) else np.zeros(0, np.int64)
    count = np.diff(s.bounds)
    size = np.maximum(np.diff(offsets), 1)

    def per_text(mask):
        return np.diff(np.append(0, np.cumsum(mask))[offsets])

    again = np.append(False, whole[1:] == whole[:-1]) if len(whole) else np.zeros(0, bool)
    again[s.bounds[:-1][s.bounds[:-1] < len(again)]] = False
    repeated = np.diff(np.append(0, np.cumsum(again))[s.bounds])
    distinct = np.bincount(np.unique(text * np.int64(1 << 40) + (whole >> np.uint64(24)).astype(np.int64)) >> 40, minlength=n) if len(whole) else np.zeros(n)
    numbers = np.stack([
        per_text((raw >= 0x41) & (raw <= 0x5A)) / size, per_text((raw > 0x20) & (raw < 0x7F) & ~words.ALNUM[words.LOWER[raw]]) / size,
        repeated / np.maximum(count, 1), distinct / np.maximum(count, 1), np.log1p(count) / 10, size / np.maximum(count, 1) / 10,
    ], 1).astype(np.float32)
    return codes // BUCKETS, codes % BUCKETS, np.minimum(numbers, 100)


def _meta_codes(columns: list[list]) -> np.ndarray:
    """Hashed metadata features of each row: one bucket for each column's value, null included."""
    out = np.zeros((len(columns[0]), len(columns)), np.int64)
    for k, values in enumerate(columns):
        strings = [f"{k}\x00{'' if v is None else v}\x00{v is None} " for v in values]
        data, offsets = words.plain(pa.array(strings, pa.large_string()))
        out[:, k] = (words.word_hashes(words.Words(data, offsets[:-1], offsets[1:], offsets)) % np.uint64(META_BUCKETS)).astype(np.int64)
    return out


def _meta(batch) -> np.ndarray:
    sizes = [None if v is None else int(np.log2(max(float(v), 1)) * 2) if float(v) == float(v) else None for v in batch.column("n_chars").to_pylist()]
    return _meta_codes([batch.column("lang").to_pylist(), batch.column("source").to_pylist(), sizes])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps: int = 250, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression, the constant last: full-batch Adam, the same on every run."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    b = np.zeros(x.shape[1], np.float32) if start is None else start.copy()
    m, v = np.zeros_like(b), np.zeros_like(b)
    weight = (weight / weight.sum()).astype(np.float32)
    for t in range(1, steps + 1):
        g = x.T @ (weight * (_sigmoid(x @ b) - y).astype(np.float32)) + ridge * b
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        b = b - np.float32(0.1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return b.astype(np.float32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ b[:-1] + b[-1]


class View(NamedTuple):
    """One view's linear model of one target and its calibration: logit = slope * score + shift."""

    weights: np.ndarray
    slope: float
    shift: float

    def logit(self, x):
        return np.clip(self.slope * _score(x, self.weights) + self.shift, -30, 30)


class Head(NamedTuple):
    """A target's model: chosen text buckets, the two views, and the weights that combine their logits."""

    chosen: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    text: View
    meta: View
    combine: np.ndarray

    def text_matrix(self, rows, buckets, numbers):
        x = np.zeros((len(numbers), len(self.chosen) + _NUMBERS), np.float32)
        at = np.minimum(np.searchsorted(self.chosen, buckets), len(self.chosen) - 1)
        hit = self.chosen[at] == buckets
        x[rows[hit], at[hit]] = 1
        x[:, len(self.chosen) :] = (numbers - self.mean) / self.spread
        return x

    def probability(self, text_x, meta_x):
        return _sigmoid(_score(np.stack([self.text.logit(text_x), self.meta.logit(meta_x)], 1), self.combine))


def _meta_matrix(codes):
    x = np.zeros((len(codes), META_BUCKETS), np.float32)
    x[np.arange(len(codes))[:, None], codes] = 1
    return x


def _choose(rows, buckets, y, n) -> np.ndarray:
    """The buckets whose presence differs most between the classes, by chi-square; sorted."""
    return _telling(np.bincount(buckets, weights=y[rows].astype(np.float32), minlength=BUCKETS), np.bincount(buckets, minlength=BUCKETS), y.mean(), n)


def _telling(bad: np.ndarray, total: np.ndarray, share: float, n: int) -> np.ndarray:
    """As ``_choose``, from each bucket's rows of class 1 and of both, among ``n`` rows with this share of class 1."""
    expected = total * share
    chi = (bad - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - total / n), 1e-9)
    best = np.argsort(-chi, kind="stable")[:CHOSEN]
    best = best[total[best] > 0]
    return np.sort(best) if len(best) else np.zeros(1, np.int64)


class Features(NamedTuple):
    """Features of texts: sorted (row, bucket) pairs as two arrays, numbers about form, codes of metadata."""

    rows: np.ndarray
    buckets: np.ndarray
    numbers: np.ndarray
    meta: np.ndarray

    def take(self, at: np.ndarray) -> Features:
        starts, ends = np.searchsorted(self.rows, at), np.searchsorted(self.rows, at, "right")
        counts = ends - starts
        index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)
        return Features(np.repeat(np.arange(len(at)), counts), self.buckets[index], self.numbers[at], self.meta[at])


def _split(y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows to fit on and rows to calibrate with, dealt class by class.

    One hold-out where each class has FEW rows; else FOLDS folds, and all rows last, with which a class's only row is
    calibrated, since no fold can do without it."""
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    every = np.arange(len(y))
    if min(map(len, classes)) >= FEW:
        hold = np.concatenate([c[: int(HOLD_OUT * len(c))] for c in classes])
        return [(np.setdiff1d(every, hold), hold)]
    holds = [np.concatenate([c[k::FOLDS] for c in classes if len(c) > 1]) for k in range(FOLDS)]
    return [*((np.setdiff1d(every, h), h) for h in holds if len(h)), (every, np.concatenate([c for c in classes if len(c) == 1] or [every[:0]]))]


class _Part:
    """Rows that one fit sees, rows that it scores for calibration, and the fit's features and weights."""

    def __init__(self, labelled: Features, y: np.ndarray, weight: np.ndarray, train: np.ndarray, hold: np.ndarray, chosen: np.ndarray | None = None):
        own = labelled.take(train)
        mean, spread = own.numbers.mean(0), own.numbers.std(0) + 1e-3
        none = View(np.zeros(1), 0, 0)
        chosen = _choose(own.rows, own.buckets, y[train], len(train)) if chosen is None else chosen
        self.head = Head(chosen, mean, spread, none, none, np.zeros(3))
        self.y, self.weight = y[train], weight[train]
        self.train, self.hold = self.matrices(own), self.matrices(labelled.take(hold))
        self.b: dict[str, np.ndarray] = {}

    def matrices(self, f: Features) -> dict[str, np.ndarray]:
        return {"text": self.head.text_matrix(f.rows, f.buckets, f.numbers), "meta": _meta_matrix(f.meta)}

    def fit(self, name: str, given: Features, what: np.ndarray) -> np.ndarray:
        """Fits a view on the own rows and pseudo-labelled ones; scores of the rows kept for calibration."""
        x = np.concatenate([self.train[name], self.matrices(given)[name]])
        weight = np.append(self.weight, np.full(len(what), PSEUDO_WEIGHT))
        start = self.b.get(name)
        self.b[name] = logistic(x, np.append(self.y, what), weight, start, 250 if start is None else 100)
        return _score(self.hold[name], self.b[name])


def _confident(head: Head, f: Features) -> dict[tuple[str, int], np.ndarray]:
    out = {}
    for name, view, x in (("text", head.text, head.text_matrix(f.rows, f.buckets, f.numbers)), ("meta", head.meta, _meta_matrix(f.meta))):
        p = _sigmoid(view.logit(x))
        out[name, 0], out[name, 1] = np.flatnonzero(p <= 1 - CONFIDENT), np.flatnonzero(p >= CONFIDENT)
    return out


class Trainer:
    """Fits, calibrates and combines the two views of one target on labelled rows of both classes. ``chosen``: the buckets of
    each part of the split, where ``labelled`` has no others."""

    def __init__(self, labelled: Features, y: np.ndarray, weight: np.ndarray, chosen: list[np.ndarray] | None = None):
        weight = weight / weight.mean()
        split = _split(y)
        self.parts = [_Part(labelled, y, weight, *p, c) for p, c in zip(split, chosen or [None] * len(split), strict=True)]
        hold = np.concatenate([h for _, h in split])
        self.y, self.weight = y[hold], weight[hold]
        self.nothing = (labelled.take(np.zeros(0, np.int64)), np.zeros(0))
        self.given = {"text": self.nothing, "meta": self.nothing}
        self.scores: dict[str, np.ndarray] = {}
        self.views: dict[str, View] = {}

    def fit(self) -> None:
        """One round: both views with the rows in ``given``, calibrated by rows that the scoring fit has not seen."""
        for name, (who, what) in self.given.items():
            score = self.scores[name] = np.concatenate([p.fit(name, who, what) for p in self.parts])
            c = logistic(score[:, None].astype(np.float32), self.y, self.weight, np.array([1, 0], np.float32))
            self.views[name] = View(self.parts[-1].b[name], float(max(c[0], 0)), float(c[1]))

    def judge(self) -> Head:
        """The views so far, not combined."""
        return self.parts[-1].head._replace(**self.views)

    def confident(self, f: Features) -> dict[tuple[str, int], np.ndarray]:
        """Rows that a view is confident of, for each view and class."""
        return _confident(self.judge(), f)

    def head(self) -> Head:
        logits = np.stack([np.clip(v.slope * self.scores[n] + v.shift, -30, 30) for n, v in self.views.items()], 1).astype(np.float32)
        combine = logistic(logits, self.y, self.weight, np.array([1, 0.5, 0], np.float32), ridge=1e-3)
        return self.parts[-1].head._replace(**self.views, combine=combine)


def co_train(rows, buckets, numbers, meta_codes, y: np.ndarray, weight: np.ndarray | None = None) -> Head | float:
    """A target's head. ``y``: 1 or 0 for labelled rows, -1 for the pool; without both classes, the share of 1 alone.

    In each round each view marks pool rows that it is confident of and hands them, as pseudo-labels of less weight, to
    the other view's next fit. Calibration and combination use labelled rows that the scoring fit has not seen.
    ``weight``: how many labels each row stands for."""
    known, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    if len(np.unique(y[known])) < 2:
        return float(y[known].mean()) if len(known) else 0.0
    every = Features(rows, buckets, numbers, meta_codes)
    trainer = Trainer(every.take(known), y[known], np.ones(len(known)) if weight is None else weight[known])
    trainer.fit()
    if not len(pool):
        return trainer.head()
    unknown = every.take(pool)
    for _ in range(ROUNDS):
        found = trainer.confident(unknown)
        for other in trainer.given:
            at = {c: rows[: POOL // 4] for (name, c), rows in found.items() if name != other}
            trainer.given[other] = (unknown.take(np.append(at[0], at[1])), np.repeat([0.0, 1.0], [len(at[0]), len(at[1])]))
        trainer.fit()
    return trainer.head()


def _draw(known: DataFrame) -> list[tuple[str, list, float]]:
    """(id, marks, labels that it stands for) of at most LABELLED rows of ``known``: all of the rarer combinations of
    marks, and of the others equally many, each the first in an order of hashes."""
    cells = sorted(known.groupBy(*TARGETS).count().collect(), key=lambda r: (r["count"], str(r)))
    out, left = [], LABELLED
    for k, cell in enumerate(cells):
        quota = min(cell["count"], left // (len(cells) - k))
        left -= quota
        mine = known.filter(F.expr(" and ".join(f"{t} <=> {'null' if cell[t] is None else cell[t]}" for t in TARGETS)))
        if quota < cell["count"]:
            mine = mine.orderBy(F.xxhash64("id"), "id").limit(quota)
        out += [(r.id, [r[t] for t in TARGETS], cell["count"] / quota) for r in mine.toLocalIterator()]
    return out


def _columns(docs: DataFrame, keys: dict) -> DataFrame:
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(n) for n, (c, t) in keys.items()])


def _used(chosen: list[np.ndarray]) -> np.ndarray:
    """Mask of the buckets that are in any of the lists."""
    out = np.zeros(BUCKETS, bool)
    for c in chosen:
        out[c] = True
    return out


_FEATURES = "doc_id string, h long, buckets array<int>, numbers array<float>, meta array<int>"


def _featured(docs: DataFrame, use: np.ndarray | None = None) -> DataFrame:
    """_FEATURES of each row; ``h`` hashes all of the row that counts here."""
    held = docs.sparkSession.sparkContext.broadcast(use)

    def run(batches):
        for s in words.slices(batches):
            w = words.words(s.data, s.offsets, words.NON_SPACE, lower=True)
            rows, buckets, numbers = text_features(w, s.data, s.offsets, held.value)
            n, meta = len(s.ids), _meta(s.rows)
            ends = np.searchsorted(rows, np.arange(n + 1))
            lists = [(ends, pa.array(buckets, pa.int32()))] + [(np.arange(n + 1) * x.shape[1], pa.array(x.ravel(), t)) for x, t in ((numbers, pa.float32()), (meta, pa.int32()))]
            yield pa.RecordBatch.from_arrays([s.ids, s.rows.column("h"), *[pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in lists]], ["doc_id", "h", "buckets", "numbers", "meta"])

    return docs.withColumn("h", F.xxhash64(*docs.columns)).mapInArrow(run, _FEATURES)


def _features(batch) -> Features:
    sizes = batch.column("buckets").value_lengths().to_numpy(zero_copy_only=False)
    n = len(sizes)
    buckets, numbers, meta = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "numbers", "meta"))
    return Features(np.repeat(np.arange(n, dtype=np.int32), sizes), buckets, numbers.reshape(n, -1), meta.reshape(n, -1))


def _counted(labelled: DataFrame, place: dict[str, int], splits: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The buckets that ``_choose`` gives for each of ``splits`` (rows, their classes). Buckets are counted where the features lie, so
    that the driver holds a count for each bucket, of one split at a time, however long the texts are."""
    marks = np.full((len(splits), len(place)), -1, np.int8)
    for k, (rows, y) in enumerate(splits):
        marks[k, rows] = y
    held = labelled.sparkSession.sparkContext.broadcast((place, marks))

    def run(batches):
        place, marks = held.value
        for b in batches:
            f, own = _features(b), marks[:, [place[i] for i in b.column("doc_id").to_pylist()]]
            for k, mark in enumerate(own):
                mark = mark[f.rows]
                found, at = np.unique(f.buckets[mark >= 0], return_inverse=True)
                n, bad = (np.bincount(at, w, len(found)).astype(np.int64) for w in (None, mark[mark >= 0] == 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(found, pa.int32()), pa.array(n), pa.array(bad)], ["split", "bucket", "n", "bad"])

    counts = stored(labelled.mapInArrow(run, "split int, bucket int, n long, bad long").groupBy("split", "bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "counts")
    out = []
    for k, (rows, y) in enumerate(splits):
        own = counts.filter(F.col("split") == k).select("bucket", "n", "bad").toArrow()
        total, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
        total[own["bucket"].to_numpy()], bad[own["bucket"].to_numpy()] = own["n"].to_numpy(), own["bad"].to_numpy()
        out.append(_telling(bad, total, y.mean(), len(rows)))
    dropped(counts)
    return out


def _only(use: np.ndarray, df: DataFrame) -> DataFrame:
    """Rows of _FEATURES with the buckets of the mask ``use`` alone."""
    held = df.sparkSession.sparkContext.broadcast(use)

    def run(batches):
        for b in batches:
            f = _features(b)
            at = held.value[f.buckets]
            ends = np.append(0, np.cumsum(np.bincount(f.rows[at], minlength=b.num_rows)))
            buckets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f.buckets[at], pa.int32()))
            yield b.set_column(b.schema.get_field_index("buckets"), "buckets", buckets)

    return df.mapInArrow(run, df.schema)


def _refill(unlabelled: DataFrame, trainers: dict[str, Trainer], turn: int) -> None:
    """Gives the views rows that the other view is confident of, out of all ``unlabelled`` rows, POOL at most: the first
    in an order of hashes that is another in each round. The rows are counted first, so few more than needed are sent."""
    held = unlabelled.sparkSession.sparkContext.broadcast({t: x.judge() for t, x in trainers.items()})
    groups = [(t, name, c) for t in trainers for name in ("text", "meta") for c in (0, 1)]

    def found(batches):
        for b in batches:
            if b.num_rows:
                f = _features(b)
                key = words.mix(b.column("h").to_numpy().view(np.uint64) ^ np.uint64(turn))
                got = {(t, *k): at for t, head in held.value.items() for k, at in _confident(head, f).items()}
                for k, g in enumerate(groups):
                    yield b, key, k, got[g][np.unique(key[got[g]], return_index=True)[1]]

    def count(batches):
        for _, _, k, at in found(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(at)], pa.int64())], ["k", "n"])

    counts = {r.k: r.n for r in unlabelled.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    share = [min(1.0, (1.2 * (POOL // 4) + 100) / max(counts.get(k, 0), 1)) for k in range(len(groups))]

    def draw(batches):
        for b, key, k, at in found(batches):
            at = at[(key[at] >> np.uint64(11)).astype(float) <= share[k] * 2.0**53]
            if len(at):
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(key[at].view(np.int64)), *[rows.column(c) for c in ("buckets", "numbers", "meta")]], ["k", "h", "buckets", "numbers", "meta"])

    drawn = unlabelled.mapInArrow(draw, "k int, h long, buckets array<int>, numbers array<float>, meta array<int>").toArrow().combine_chunks()
    key, group = drawn["h"].to_numpy().view(np.uint64), drawn["k"].to_numpy()
    for t, trainer in trainers.items():
        for other in trainer.given:
            at = []
            for c in (0, 1):
                mine = np.flatnonzero(group == next(k for k, g in enumerate(groups) if g[0] == t and g[1] != other and g[2] == c))
                at.append(mine[np.argsort(key[mine], kind="stable")][: POOL // 4])
            rows = drawn.take(pa.array(np.concatenate(at))).combine_chunks()
            what = np.repeat([0.0, 1.0], [len(x) for x in at])
            trainer.given[other] = (_features(rows.to_batches()[0]), what) if len(what) else trainer.nothing


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, Head | float]:
    """A head for each of TARGETS, fitted on at most LABELLED labelled rows, drawn by ``_draw`` from labels that have a
    document. In each round each view marks, out of all other documents, those that it is confident of, and hands POOL
    of them at most to the other view's next fit. Texts are read once for that: the features that the fits use are
    stored. Labels with null id are left out; of repeated ones the worse counts."""
    spark = docs.sparkSession
    prepare(spark)
    keys = {"doc_id": (doc_id, "string"), "text": (text, "string"), "lang": ("lang", "string"), "source": ("source", "string"), "n_chars": ("n_chars", "double")}
    own = _columns(docs, keys)
    known = labels.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("id"), *[F.expr(e).cast("int").alias(t) for t, e in TARGETS.items()])
    known = known.groupBy("id").agg(*[F.max(t).alias(t) for t in TARGETS]).join(own.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    known = stored(known, "labels")
    wanted = {i: (m, w) for i, m, w in sorted(_draw(known), key=lambda r: r[0])}
    dropped(known)
    if not wanted:
        return {t: 0.0 for t in TARGETS}
    ids = F.broadcast(spark.createDataFrame([(i,) for i in wanted], "id string"))  # LABELLED at most
    place = {i: k for k, i in enumerate(wanted)}
    found = stored(_featured(own.join(ids, F.col("doc_id") == F.col("id"), "left_semi")), "labelled")
    if found.count() > len(wanted):  # of repeated documents one
        found = stored(found.groupBy("doc_id").agg(F.max_by(F.struct("h", "buckets", "numbers", "meta"), "h").alias("row")).select("doc_id", "row.*"), "labelled")
    marks, weight = [m for m, _ in wanted.values()], np.array([w for _, w in wanted.values()], float)
    out: dict[str, Head | float] = {}
    known_rows: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for k, t in enumerate(TARGETS):
        y = np.array([-1 if m[k] is None else m[k] for m in marks])
        at = np.flatnonzero(y >= 0)
        if len(np.unique(y[at])) < 2:
            out[t] = float(y[at].mean()) if len(at) else 0.0
        else:
            known_rows[t] = at, y[at]
    trainers: dict[str, Trainer] = {}
    if known_rows:
        splits = [(t, at[train], y[train]) for t, (at, y) in known_rows.items() for train, _ in _split(y)]
        chosen = _counted(found, place, [(rows, y) for _, rows, y in splits])
        got = _only(_used(chosen), found).toArrow()
        got = got.take(pa.array(np.argsort([place[i] for i in got["doc_id"].to_pylist()]))).combine_chunks()
        labelled = _features(got.to_batches()[0])
        for t, (at, y) in known_rows.items():
            trainers[t] = Trainer(labelled.take(at), y, weight[at], [c for (u, _, _), c in zip(splits, chosen, strict=True) if u == t])
            trainers[t].fit()
    dropped(found)
    if trainers:
        use = _used([p.head.chosen for x in trainers.values() for p in x.parts])
        rest = stored(_featured(own.join(ids, F.col("doc_id") == F.col("id"), "left_anti"), use).drop("doc_id"), "features")
        for turn in range(ROUNDS):
            _refill(rest, trainers, turn)
            for x in trainers.values():
                x.fit()
        dropped(rest)
    return {t: trainers[t].head() if t in trainers else out[t] for t in TARGETS}


def score(docs: DataFrame, heads: dict[str, Head | float], doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, keep) of each row, or with ``keep`` the kept rows of ``docs`` as they are.

    A row is kept where no target's combined probability reaches REJECT. Null and empty texts have no text features and
    are scored by what remains; null or absent metadata counts as a value of its own. A target without labels of both classes rejects nothing. No shuffle."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(heads)
    schema = docs.schema if keep else f"doc_id {docs.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"p_{t} double" for t in TARGETS) + ", keep boolean"
    names = {"_id": doc_id, "_text": text, "_lang": "lang", "_source": "source", "_n": "n_chars"}
    given = [(F.col(c) if c in docs.columns else F.lit(None)).cast({"_n": "double", "_id": docs.schema[doc_id].dataType}.get(n, "string")).alias(n) for n, c in names.items()]

    def run(batches):
        use = _used([h.chosen for h in held.value.values() if isinstance(h, Head)])
        for s in words.slices(batches, "_text", "_id"):
            w = words.words(s.data, s.offsets, words.NON_SPACE, lower=True)
            features = text_features(w, s.data, s.offsets, use)
            own = pa.RecordBatch.from_arrays([s.rows.column(c) for c in ("_lang", "_source", "_n")], ["lang", "source", "n_chars"])
            meta_x = _meta_matrix(_meta(own))
            p = {t: h.probability(h.text_matrix(*features), meta_x) if isinstance(h, Head) else np.full(len(s.ids), h) for t, h in held.value.items()}
            bad = np.any([x >= REJECT for t, x in p.items() if isinstance(held.value[t], Head)] or [np.zeros(len(s.ids), bool)], axis=0)
            if keep:
                yield s.rows.select([c for c in s.rows.schema.names if c not in names]).filter(pa.array(~bad))
            else:
                yield pa.RecordBatch.from_arrays([s.ids, *[pa.array(p[t].astype(float)) for t in TARGETS], pa.array(~bad)], ["doc_id", *[f"p_{t}" for t in TARGETS], "keep"])

    return docs.select(*(["*"] if keep else []), *given).mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
