"""MinHash near-dedup by min-max hashing: a permutation gives a set's smallest and its largest value, both are banded, and
links are confirmed on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, stored
from . import jaccard, words

SHINGLE, SIMILARITY = 5, (80, 100)  # unless a caller says otherwise
ROWS = 6  # values of one band
MISS = 1e-9  # chance, at most, that two sets just alike enough share no band
SEED = 0xA0761D6478BD642F


def groups_of(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """How many groups of ``rows`` permutations are needed: each gives a band of minima and one of maxima, and sets of
    this similarity share any one band with a chance of similarity ** rows."""
    return max(1, int(np.ceil(np.log(miss) / np.log1p(-min(similarity**rows, 1 - 1e-12)) / 2)))


def bands(elements: np.ndarray, bounds: np.ndarray, groups: int, rows: int = ROWS) -> np.ndarray:
    """2 * ``groups`` band hashes of each set (none of them empty), a row a set.

    Each permutation of the 64-bit hashes, an exclusive or and an odd factor, is evaluated once and keeps both the
    smallest and the largest value of a set; ``rows`` permutations make a band of minima and one of maxima."""
    out = np.zeros((len(bounds) - 1, 2 * groups), np.uint64)
    seeds = words.mix(np.arange(1, 2 * groups * rows + 1, dtype=np.uint64) * np.uint64(SEED)).reshape(groups, rows, 2)
    at = bounds[:-1]
    value = np.empty_like(elements)
    for g in range(groups):
        ends = out[:, 2 * g : 2 * g + 2]
        for a, b in seeds[g]:
            np.bitwise_xor(elements, b, out=value)
            np.multiply(value, a | np.uint64(1), out=value)
            for k, pick in enumerate((np.minimum, np.maximum)):
                ends[:, k] = words.mix(ends[:, k] + pick.reduceat(value, at))
    return words.mix(out + np.arange(2 * groups, dtype=np.uint64) * np.uint64(SEED))


_BASE = "doc_id long, n_shingles long, set long, keys array<long>"


def _base(k: int, groups: int):
    """A row for each text; the first of a slice that has a set carries its band hashes."""

    def run(batches):
        for x in jaccard._sets(batches, k):
            rows, n = x.distinct(), len(x.ids)
            offsets = np.zeros(n + 1, np.int32)
            offsets[rows + 1] = 2 * groups
            values = np.zeros(0, np.uint64)
            if len(rows):
                sizes = x.sizes()[rows]
                values = bands(np.concatenate([x.of(r) for r in rows.tolist()]), np.append(0, np.cumsum(sizes)), groups).ravel()
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([x.slice.ids, pa.array(x.sizes()), x.column(), keys], ["doc_id", "n_shingles", "set", "keys"])

    return run


def dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: links are pairs of different sets of ``shingle``-word shingles whose
    Jaccard similarity is at least num / den; component_id is the smallest doc_id reached by links or equal sets, and
    the row of that id is kept.

    1. One pass over the texts gives each distinct set its min-max signature in bands. Two sets just alike enough share
    none of them with a chance below MISS, others with a smaller one. 2. The sets with a band hash in common are a
    candidate group, of any size. 3. Groups are confirmed on full sets: those whose sets are of several components grow
    trees in chunks, whose pairs are compared in place or named once and compared after (``jaccard.joined``), so no
    group is expanded into pairs and none is cut. 4. Links make components.
    Words are runs of anything but white space, A-Z lower-cased. A text with fewer words than a shingle has its whole
    sequence as its one element; null, empty and word-less texts have 0 shingles, are linked with nothing, and stay.
    Null ids count as the largest, and a component of null ids alone has a null id and keeps its rows (``kept`` is
    true); rows that share an id are rows of their own. Extra columns are not read. No rows give none."""
    prepare(docs.sparkSession)
    like = jaccard.Likeness(*similarity)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    groups = groups_of(similarity[0] / similarity[1])
    base = stored(texts.mapInArrow(_base(shingle, groups), _BASE), "signatures")
    keyed = base.filter("size(keys) > 0").select(F.explode("keys").alias("key"), "set", F.col("n_shingles").cast("int").alias("n"))
    members = stored(jaccard.shared(keyed).distinct(), "candidates")
    out = jaccard.joined(texts, base.select("doc_id", "n_shingles", "set"), members, shingle, like, F.lit(1)).drop("set", "root")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 5, (85, 100))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i : i + k - 1], ' ') as t from (select doc_id, w, least(5, len(w)) as k, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, link.y from reach r join link on link.x = r.other),
found as (select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(other) from reach r where r.doc_id = d.doc_id) as component_id from d left join n on n.doc_id = d.doc_id)
select *, doc_id = component_id as kept from found
"""
