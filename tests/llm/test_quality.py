import os

import pytest
from pyspark.sql import functions as F

from bidlattice.llm import quality

from .cases import documents

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fitted, held = labels.filter("doc_id % 4 > 0"), labels.filter("doc_id % 4 = 0")
    got = quality.score(docs, quality.fit(docs, fitted)).join(held, "doc_id")
    clean = got.filter("quality = 1 and toxic = 0").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    bad = got.filter("quality = 0 or toxic = 1").agg(F.avg((~F.col("keep")).cast("int"))).first()[0]
    assert clean > 0.98 and bad > 0.9


def test_hard_cases_without_and_with_few_labels(spark):
    docs = documents(spark).withColumn("n_chars", F.when(F.col("doc_id") > 3, F.col("n_chars"))).withColumn("lang", F.when(F.col("doc_id") > 5, F.col("lang")))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 0, 1), (3, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        heads = quality.fit(docs, labels)
        rows = quality.score(docs, heads).collect()
        assert len(rows) == docs.count() and all(r.keep is not None for r in rows)
        kept = quality.score(docs, heads, keep=True)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.keep}
    assert all(r.keep for r in quality.score(docs, quality.fit(docs, none)).collect())
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), few)).count() == 0


def test_co_training_exchanges_pseudo_labels():
    import numpy as np

    rng = np.random.default_rng(0)
    n = 600
    y = rng.integers(0, 2, n)
    buckets = np.stack([y * 10 + rng.integers(0, 5, n), rng.integers(100, 140, n)], 1)
    meta = np.stack([y + 2 * rng.integers(0, 2, n), rng.integers(10, 20, n)], 1)
    marks = np.where(np.arange(n) < 200, y, -1)
    head = quality.co_train(np.repeat(np.arange(n), 2), buckets.ravel(), np.zeros((n, 6), np.float32), meta, marks)
    p = head.probability(head.text_matrix(np.repeat(np.arange(n), 2), buckets.ravel(), np.zeros((n, 6), np.float32)), quality._meta_matrix(meta))
    assert ((p >= 0.5) == y).mean() > 0.97


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_few_labels_give_models_that_reject(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    heads = quality.fit(docs, labels)
    assert all(isinstance(h, quality.Head) for h in heads.values())
    got = quality.score(docs, heads).join(labels, "doc_id")
    for bad in ("quality = 0", "toxic = 1"):
        assert got.filter(bad).filter("not keep").count() >= 0.7 * got.filter(bad).count()
    assert got.filter("quality = 1 and toxic = 0").filter("keep").count() >= 0.95 * got.filter("quality = 1 and toxic = 0").count()


def test_every_label_of_a_rare_class_is_drawn(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 40)
    known = spark.createDataFrame([(str(i), int(i < 5), int(i in (7, 8, 9))) for i in range(1000)], "id string, low_quality int, toxic int")
    got = quality._draw(known)
    assert len(got) == 40 and {i for i, m, _ in got if any(m)} == set("0123478" + "9")
    assert abs(sum(w for _, _, w in got) - 1000) < 1e-6


def test_splits_keep_both_classes():
    import numpy as np

    for ones in (1, 2, 7, 500):
        y = np.append(np.zeros(500, int), np.ones(ones, int))
        for train, hold in quality._split(y):
            assert set(y[train]) == {0, 1}
        held = np.concatenate([h for _, h in quality._split(y)])
        assert set(y[held]) == {0, 1} and len(held) == len(set(held))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_labels_without_documents_and_a_small_pool_leave_the_fit_whole(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 80)
    monkeypatch.setattr(quality, "POOL", 8)
    sizes, given = [], set()

    class Spy(quality.Trainer):
        def fit(self):
            sizes.append(sum(len(h) for h in self.scores.values()) or len(self.y))
            for f, _ in self.given.values():
                given.update(map(tuple, f.numbers.tolist()))
            super().fit()

    monkeypatch.setattr(quality, "Trainer", Spy)
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    strays = spark.range(10**6, 10**6 + 2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    quality.fit(docs, labels.select("doc_id", "quality", "toxic").unionByName(strays.select("doc_id", "quality", "toxic")))
    assert max(sizes[:2]) == 80  # all of the sample has documents
    assert len(given) > 8  # more documents than one round's pool


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_the_driver_holds_chosen_features_alone(spark, monkeypatch):
    import numpy as np

    got = []

    class Spy(quality.Trainer):
        def __init__(self, labelled, y, weight, *chosen):
            got.append((labelled, y))
            super().__init__(labelled, y, weight, *chosen)
            self.chosen = [p.head.chosen for p in self.parts]
            got[-1] += (self.chosen,)

    monkeypatch.setattr(quality, "Trainer", Spy)
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    quality.fit(docs.unionByName(docs.limit(20)), labels)
    every = np.unique(np.concatenate([c for _, _, chosen in got for c in chosen]))
    assert len(got) == 2 and all(np.isin(f.buckets, every).all() for f, _, _ in got)
    for f, y, chosen in got:  # and the choice among all features is the same as among those
        for (train, _), c in zip(quality._split(y), chosen, strict=True):
            own = f.take(train)
            again = quality._choose(own.rows, own.buckets, y[train], len(train))
            assert len(c) <= quality.CHOSEN and np.isin(c, np.unique(own.buckets)).all() and len(again) == len(c)
