"""Candidates for each company's best open tenders: those whose score may be among its first, found without joining pairs.

Blocks of companies meet chunks of tenders. In a cell each company's scores with all tenders are worked out at once by
numpy, up to the rounding of scores, and those pairs stay that may be among the company's first there. Pairs of a
company with a buyer it knows are left out: they are few, and all of them are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .views import Graph

CHUNK = 50_000  # tenders of a cell
BLOCK = 1_000  # companies of a cell
SLACK = 0.13  # a score is rounded to a tenth, and each dimension to four digits before


def _spread(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def candidates(g: Graph, companies: DataFrame, tenders: DataFrame, known: DataFrame, words: int, limit: int) -> DataFrame:
    """(company, tender) that may be among the first ``limit`` of the company, pairs in ``known`` apart.

    ``companies``: company, c_points, match (value fit by value band), places, known, mine.., rel_points, sets.
    ``tenders``: tender, t_points, band, city, prov, has_buyer, inds.. ."""
    import numpy as np
    import pandas as pd

    n_companies, n_tenders = companies.count(), tenders.count()
    blocks, chunks = max(1, min(n_companies, max(32, n_companies // BLOCK))), max(1, -(-n_tenders // CHUNK))
    mine = known.groupBy("company").agg(F.collect_set("tender").alias("skip"))
    left = companies.join(mine, "company", "left").withColumn("block", _spread("company", blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = tenders.withColumn("chunk", _spread("tender", chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def bits(columns) -> np.ndarray:
        """Rows of words to rows of single bits."""
        w = np.ascontiguousarray(np.stack([np.asarray(c, "int64") for c in columns], 1))
        return np.unpackbits(w.view("uint8"), axis=1, bitorder="little").astype("float32")

    def packed(rows: np.ndarray) -> np.ndarray:
        """Columns of 0 and 1 to rows of 64-bit words."""
        b = np.packbits(rows > 0, axis=0).T
        return np.ascontiguousarray(np.pad(b, ((0, 0), (0, -b.shape[1] % 8)))).view("uint64")

    def cell(c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(t):
            return pd.DataFrame({"company": [], "tender": []}, dtype="object")
        where = {x: i for i, x in enumerate(t.tender)}
        some = t.inds0.notna().to_numpy()
        sets, of = np.unique(np.stack([t[f"inds{w}"].fillna(0).to_numpy("int64") for w in range(words)], 1), axis=0, return_inverse=True)
        of, wanted = of.reshape(-1), bits(sets.T)
        size = wanted.sum(1)
        # each set's industries, filled up with one that no tender has
        members = np.argsort(-wanted, axis=1, kind="stable")[:, : max(1, int(size.max()))]
        members = np.where(np.arange(members.shape[1]) < size[:, None], members, wanted.shape[1])
        cities, city = np.unique(t.city.to_numpy("str"), return_inverse=True)
        provs, prov = np.unique(t.prov.to_numpy("str"), return_inverse=True)
        nowhere = ((cities == "")[city]) & ((provs == "")[prov])
        band, points, buyer = t.band.to_numpy("int64"), t.t_points.to_numpy("float64"), t.has_buyer.to_numpy(bool)
        names, out = t.tender.to_numpy(), []
        for r in c.itertuples(index=False):
            own = None if pd.isna(r.mine0) else bits([[getattr(r, f"mine{w}")] for w in range(words)])[0]
            common = wanted @ own if own is not None else np.zeros(len(size))
            shares = common > 0
            capability = np.full(len(size), 0.5) if own is None else np.divide(common, size, out=np.zeros(len(size)), where=size > 0)
            history = np.where(shares, r.rel_points, 0.3)
            if not shares.all() and r.sets is not None and len(r.sets):
                theirs = bits([[s[f"t_inds{w}"] for s in r.sets] for w in range(words)])
                bids, wins = (np.array([s[k] for s in r.sets], "int64") for k in ("bids", "wins"))
                rows = np.repeat(theirs, bids, axis=0)  # one for each tender, of which the first of a set are those won
                won = np.arange(len(rows)) - np.repeat(np.cumsum(bids) - bids, bids) < np.repeat(wins, bids)
                table, won = packed(np.c_[rows, np.zeros(len(rows))]), packed(won[:, None])
                for at in range(0, len(size), 65_536):
                    some_sets = members[at : at + 65_536]
                    met = table[some_sets[:, 0]]
                    for k in range(1, some_sets.shape[1]):
                        met |= table[some_sets[:, k]]
                    n, n_won = (np.bitwise_count(x).sum(1, dtype="int64") for x in (met, met & won))
                    far = np.where(n > 0, n_won / np.maximum(n, 1), 0.3)
                    history[at : at + 65_536] = np.where(shares[at : at + 65_536], history[at : at + 65_536], far)
            by_set = 15 * capability + 10 * history
            s = points + r.c_points + np.where(some, by_set[of], 15 * 0.5 + 10 * 0.4)
            s += 10 * np.minimum(1.0, 0.3 + np.where(buyer, 0.3, 0.0) + 0.15 * np.where(some, (size - common)[of], 0))
            s += 10 * np.append(np.asarray(r.match, "float64"), 0.5)[band]  # band -1: no value
            if r.places is None:
                s += 10 * 0.5
            else:
                near, inside = (np.isin(x, list(r.places)) & (x != "") for x in (cities, provs))
                s += 10 * np.where(nowhere, 0.5, np.where(near[city], 1.0, np.where(inside[prov], 0.7, 0.2)))
            if r.skip is not None:
                s[[where[x] for x in r.skip if x in where]] = -np.inf
            least = np.partition(s, -limit)[-limit] if limit < len(s) else -np.inf
            keep = np.flatnonzero((s >= least - SLACK) & (s > -np.inf))
            out.append(pd.DataFrame({"company": r.company, "tender": names[keep]}))
        return pd.concat(out)

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(cell, "company string, tender string")
