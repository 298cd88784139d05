"""Vector code compression: distinct integer parts with their counts, weighted Lloyd over them, codes joined back to vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, prepare, stored
from . import vectors

POSITIONS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def _parts(batch: pa.RecordBatch):
    """(position, rows, their parts) of each position that a batch has."""
    position = batch.column("position").to_numpy()
    column = batch.column("part")
    x = column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)
    for p in np.unique(position).tolist():
        rows = np.flatnonzero(position == p)
        yield p, rows, x[rows]


def _sums(books):
    """(position, entry, n, s): of each entry that a partition's parts are nearest to, how many vectors and their sum."""

    def run(batches):
        c = books.value
        n, s = np.zeros(c.shape[:2], np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            weight = b.column("n").to_numpy()
            for p, rows, x in _parts(b):
                best, _ = vectors.nearest(x, c[p])
                np.add.at(n[p], best, weight[rows])
                order = np.argsort(best, kind="stable")
                own, at = np.unique(best[order], return_index=True)
                s[p, own] += np.add.reduceat((x * weight[rows, None])[order], at)
        position, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"position": pa.array(position, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[position, entry]), "s": pa.array(list(s[position, entry]), pa.list_(pa.int64()))})

    return run


def _coded(books):
    def run(batches):
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for p, rows, x in _parts(b):
                code[rows], error[rows] = vectors.nearest(x, books.value[p])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("position", "part", "n")], pa.array(code), pa.array(error)], ["position", "part", "n", "entry", "error"])

    return run


def codebooks(distinct: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Final entries (position, entry, component) after ``rounds`` of weighted Lloyd over (position, part, n).

    A round assigns each distinct part once; one row of sums for each entry and partition is merged, and the merged
    rows, as many as entries, come to the driver."""
    spark, c = distinct.sparkSession, first
    for _ in range(rounds):
        found = distinct.mapInArrow(_sums(spark.sparkContext.broadcast(c)), "position int, entry int, n long, s array<long>")
        merged = found.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(c.shape[2])]).alias("s"))
        c = c.copy()
        for r in merged.collect():
            c[r.position, r.entry] = [x // r.n for x in r.s]
    return c


def compress(rows: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row whose vector is not null and has no null or
    non-finite component; ``code`` has two hex digits for each part, so there are at most 256 entries.

    Components x become floor(scale * x), and vectors are cut into equal parts. Equal parts of a position are one row
    with its number of vectors; weighted Lloyd runs over those, from the parts of the smallest ids (rows that share an
    id in the order of their vectors, null ids last). Final codes and errors are joined back by the part; parts and
    labels that very many rows have meet their rows by broadcast, the others by a shuffle. ``label_error`` is the error
    of all rows with the label, null labels together. Rows that share an id are rows of their own; fewer rows than
    entries give fewer entries; no rows give none. The vectors' length is the most common one that the positions divide
    (the smaller of equals); a row of another length stays, with null code and error, and its label's error counts the
    others (null where there are none). A component beyond ``vectors.MOST`` stops the job."""
    spark = rows.sparkSession
    prepare(spark)
    usable = rows.filter(vectors.finite(F.col(embedding))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), vectors.integers(F.col(embedding), scale).alias("v"))
    base = stored(usable.withColumn("row", F.monotonically_increasing_id()), "integers")
    fits = (F.size("v") > 0) & (F.size("v") % positions == 0)
    lengths = base.filter(fits).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    width = lengths.size if lengths else 0
    fitting = base.filter(F.size("v") == width) if lengths else base.limit(0)
    first = [r.v for r in fitting.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        return base.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    own = width // positions
    start = np.array(first, np.int64).reshape(len(first), positions, own).transpose(1, 0, 2)

    cut = F.array(*[F.struct(F.lit(p).alias("position"), F.slice("v", p * own + 1, own).alias("part")) for p in range(positions)])
    parts = fitting.select("row", "vec_id", "label", F.explode(cut).alias("x")).select("row", "vec_id", "label", "x.*")
    distinct = stored(parts.groupBy("position", "part").agg(F.count("*").alias("n")), "parts")
    books = codebooks(distinct, start, rounds)
    coded = stored(distinct.mapInArrow(_coded(spark.sparkContext.broadcast(books)), "position int, part array<int>, n long, entry long, error long"), "coded")
    back = vectors.spread(parts, coded, ["position", "part"])
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0"))), "")
    found = back.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), digits.alias("code"), F.sum("error").alias("error"))
    other = base.filter(F.size("v") != width).select("row", "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    found = stored(found.unionByName(other), "codes")
    dropped(coded)
    labels = stored(found.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return vectors.spread(found, labels, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    d = "list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda i: f"a{i} as materialized (select p, v, any_value(n) as n, arg_min(c, (d, c)) as c, min(d) as d from (select k.p, k.v, k.n, m.c, {d}::bigint as d from k join c{i} m on m.p = k.p) group by 1, 2)"
    steps = [
        f"e as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "r as (select *, row_number() over (order by vec_id) - 1 as r from e)",
        f"x as materialized (select vec_id, label, p, v[p * len(v) // {POSITIONS} + 1 : (p + 1) * len(v) // {POSITIONS}] as v, r from (select *, unnest(range({POSITIONS})) as p from r))",
        "k as materialized (select p, v, count(*) as n from x group by 1, 2)",
        f"c0 as materialized (select p, r as c, v from x where r < {ENTRIES})",
    ]
    for i in range(ROUNDS):
        mean = "list(((s - ((s % n) + n) % n) // n)::bigint order by i)"
        steps += [near(i), f"s{i} as (select p, c, {mean} as v from (select p, c, i, sum(n * y) as s, sum(n) as n from (select p, c, n, unnest(v) as y, unnest(range(len(v))) as i from a{i}) group by 1, 2, 3) group by 1, 2)"]
        steps += [f"c{i + 1} as materialized (select o.p, o.c, coalesce(n.v, o.v) as v from c{i} o left join s{i} n on n.p = o.p and n.c = o.c)"]
    steps += [near(ROUNDS), f"f as (select vec_id, label, string_agg(printf('%02x', a.c), '' order by x.p) as code, sum(d)::bigint as error from x join a{ROUNDS} a on a.p = x.p and a.v = x.v group by 1, 2)"]
    return f"""with {", ".join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, c)) from c{ROUNDS}) as codebooks_sha256 from f"""


ORACLE = _oracle()
