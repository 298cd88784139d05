"""A stored inverted index: positional postings in segments sorted by term, to which loads add without rewriting; a top-k
by BM25 that passes over blocks of texts by their bounds; and matching with and, or, not and phrases, by cover density.

A target folder holds, for each segment, postings (segment, term, block, key, length, tf, positions), sorted by term and
cut into files by it, a list of the files with their first and last terms, bounds (segment, term, block, n, tf, length)
and texts (segment, key, length). A text that comes again stands in the new segment alone: a list of dead keys, made
when it is added, rules the old one out. A manifest names what belongs to the index, committed by one rename."""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..session import dropped, prepare, scratch, stored
from ..streaming import versions
from . import search

BLOCK = 32  # texts of a block, on average
FILE_ROWS = 2_000_000  # postings of a file, on average
ROW_GROUP = 4 << 20  # bytes of a row group of postings
FEW = 500  # block numbers that go into a filter; more are joined
BROADCAST_ROWS = 1_000_000  # keys or block numbers that a broadcast may hold
FAN = 4  # segments of like size that are merged into one
COVER = 0.1  # weight of a cover without other words in it
_TOP = "\U0010ffff"


def _schema(names: dict) -> str:
    return f"segment string, term string, block long, key {names['key']}, length int, tf int, positions array<int>"


def _none(spark: SparkSession, names: dict, value: str) -> DataFrame:
    return spark.createDataFrame([], f"key {names.get('key', 'string')}, {value} double")


def _table(spark: SparkSession, target: str, what: str, names: dict, schema: str) -> DataFrame:
    """A table of all segments that the manifest names and that have it."""
    paths = [f"{target}/{what}/{s['id']}" for s in names["segments"]] if what != "dead" else [f"{target}/dead/{d['id']}" for d in names["dead"] if d["rows"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _alive(spark: SparkSession, target: str, names: dict, rows: DataFrame) -> DataFrame:
    """``rows`` (segment, key, ...) without the texts that a later segment has, or that were removed."""
    n = sum(d["rows"] for d in names["dead"])
    if not n:
        return rows
    return rows.join(_few(_table(spark, target, "dead", names, f"segment string, key {names['key']}, length int"), n), ["segment", "key"], "left_anti")


def _write(spark: SparkSession, target: str, segment: str, rows: DataFrame, files: int) -> None:
    """Postings sorted by term, their list of files, and bounds."""
    order = ["term", "block", "key"]
    at = f"{target}/postings/{segment}"
    rows.sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP).parquet(at)
    back = spark.read.parquet(at)
    back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("term").alias("low"), F.max("term").alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{target}/files/{segment}")  # a row for each file
    dealt = back.select("segment", "term", "block", "tf", "length").repartitionByRange(files, "term", "block")  # and so by what is counted
    bounds = dealt.groupBy("segment", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("length").alias("length"))
    bounds.sortWithinPartitions("term", "block").write.parquet(f"{target}/bounds/{segment}")


_BOUNDS = "segment string, term string, block long, n long, tf int, length int"


def _placed(split: DataFrame, names: dict) -> DataFrame:
    """(key, length, term, positions) of each distinct term of ``split`` (key, terms), and of each text a row without a term: what
    is shuffled after is a row for each term of a text and not for each word."""

    def run(batches):
        for b in batches:
            lists = b.column("terms")
            offsets = lists.offsets.to_numpy()
            flat, sizes = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode(), np.diff(offsets)
            position = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            code = np.repeat(np.arange(b.num_rows), sizes) * len(flat.dictionary) + flat.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(code[order]) > 0)) if len(code) else np.zeros(0, np.int64)
            row, term = np.divmod(code[order[starts]], max(len(flat.dictionary), 1))
            length, places = pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(position[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("key"), length, pa.nulls(b.num_rows, flat.dictionary.type), pa.nulls(b.num_rows, places.type)], _PLACED)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row)), length.take(pa.array(row)), flat.dictionary.take(pa.array(term)), places], _PLACED)

    return split.mapInArrow(run, f"key {names['key']}, length int, term string, positions array<int>")


_PLACED = ["key", "length", "term", "positions"]


def append(spark: SparkSession, target: str, df: DataFrame, key: str, text: str) -> dict:
    """Adds texts as a segment of their own, and returns the manifest. Nothing that is there is written again.

    A key that is there already is replaced. Rows without a key are not indexed; of rows that share a key the one with
    the greatest text is. Texts without words count as texts of length 0."""
    prepare(spark)
    names = versions.read(spark, target) or {"segments": [], "dead": [], "texts": 0, "words": 0, "key": df.schema[key].dataType.simpleString()}
    segment = uuid.uuid4().hex
    texts = df.select(F.col(key).cast(names["key"]).alias("key"), F.col(text).cast("string").alias("text")).filter("key is not null")
    n = texts.agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")).first()
    if n.n > n["keys"]:
        texts = texts.groupBy("key").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    found = stored(_placed(texts.select("key", search.terms("text").alias("terms")), names), "placed")  # texts are split once
    found.filter("term is null").select(F.lit(segment).alias("segment"), "key", "length").write.parquet(f"{target}/texts/{segment}")
    schema = f"segment string, key {names['key']}, length int"
    own = spark.read.schema(schema).parquet(f"{target}/texts/{segment}")
    words = own.agg(F.sum("length")).first()[0] or 0
    blocks, files = max(1, math.ceil(n["keys"] / BLOCK)), max(1, math.ceil(words / FILE_ROWS))

    rows = found.filter("term is not null").select(F.lit(segment).alias("segment"), "term", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", "length", F.size("positions").alias("tf"), "positions")
    _write(spark, target, segment, rows.repartitionByRange(files, "term", "block", "key"), files)
    dropped(found)

    gone = 0
    if names["segments"]:
        known = _alive(spark, target, names, _table(spark, target, "texts", names, schema))
        gone = _bury(spark, target, segment, known.join(_few(own.select("key"), n["keys"]), "key", "left_semi").select("segment", "key", "length"), names)
    names["segments"].append({"id": segment, "texts": n["keys"], "blocks": blocks})
    return _commit(spark, target, names | {"texts": names["texts"] + n["keys"], "words": names["words"] + words})


def _bury(spark: SparkSession, target: str, load: str, rows: DataFrame, names: dict) -> int:
    rows.write.parquet(f"{target}/dead/{load}")
    n = spark.read.schema(f"segment string, key {names['key']}, length int").parquet(f"{target}/dead/{load}").agg(F.count("*").alias("n"), F.sum("length").alias("words")).first()
    names["dead"].append({"id": load, "rows": n.n})
    names["texts"], names["words"] = names["texts"] - n.n, names["words"] - (n.words or 0)
    return n.n


def _commit(spark: SparkSession, target: str, names: dict) -> dict:
    names["version"] = names.get("version", 0) + 1
    versions.commit(spark, target, names["version"], names)
    return names


def remove(spark: SparkSession, target: str, keys: DataFrame) -> dict:
    """Takes the texts of ``keys`` (key) out of the index, and returns the manifest; unknown keys change nothing."""
    names = versions.read(spark, target)
    known = _alive(spark, target, names, _table(spark, target, "texts", names, f"segment string, key {names['key']}, length int"))
    _bury(spark, target, uuid.uuid4().hex, known.join(keys.select(F.col("key").cast(names["key"])).distinct(), "key", "left_semi").select("segment", "key", "length"), names)
    return _commit(spark, target, names)


def merge(spark: SparkSession, target: str, fan: int = FAN) -> dict:
    """Merges segments of like size, ``fan`` or more of one power of ``fan``, into one each, without their dead texts; returns the
    manifest. Searches of manifests read before go on: the old files stay."""
    names = versions.read(spark, target)
    tiers: dict[int, list] = {}
    for s in names["segments"]:
        tiers.setdefault(int(math.log(max(s["texts"], 1), fan) + 1e-9), []).append(s)
    for own in [t for t in tiers.values() if len(t) >= fan]:
        segment, ids = uuid.uuid4().hex, [s["id"] for s in own]
        part = names | {"segments": own}
        schema = f"segment string, key {names['key']}, length int"
        _alive(spark, target, names, _table(spark, target, "texts", part, schema)).withColumn("segment", F.lit(segment)).write.parquet(f"{target}/texts/{segment}")
        n = spark.read.schema(schema).parquet(f"{target}/texts/{segment}").agg(F.count("*").alias("n"), F.sum("length").alias("words")).first()
        blocks, files = max(1, math.ceil(n.n / BLOCK)), max(1, math.ceil((n.words or 0) / FILE_ROWS))
        rows = _alive(spark, target, names, _table(spark, target, "postings", part, _schema(names)))
        rows = rows.withColumns({"segment": F.lit(segment), "block": F.pmod(F.xxhash64("key"), F.lit(blocks))})
        _write(spark, target, segment, rows.select(*[c.split()[0] for c in _schema(names).split(", ")]).repartitionByRange(files, "term", "block", "key"), files)
        names["segments"] = [s for s in names["segments"] if s["id"] not in ids] + [{"id": segment, "texts": n.n, "blocks": blocks}]
    if tiers:
        left = {s["id"] for s in names["segments"]}
        for d in names["dead"]:  # of merged segments nothing is left to rule out
            dead = spark.read.schema(f"segment string, key {names['key']}, length int").parquet(f"{target}/dead/{d['id']}")
            d["rows"] = dead.filter(F.col("segment").isin(*left)).count()
        names["dead"] = [d for d in names["dead"] if d["rows"]]
    return _commit(spark, target, names)


def _fits(words: list[str], begins: bool) -> Column:
    """A filter on ``term`` that reaches the scan."""
    return reduce(lambda a, b: a | b, [F.col("term").startswith(w) if begins else F.col("term") == w for w in words])


def postings(spark: SparkSession, target: str, words: list[str], begins: bool = False, names: dict | None = None) -> DataFrame:
    """Postings of live texts whose term is one of ``words``, or begins with one; only files in which such a term may
    stand are opened, and of those the row groups and pages whose terms fit."""
    names = names or versions.read(spark, target)
    lists = spark.read.schema("file string, low string, high string, n long").parquet(*[f"{target}/files/{s['id']}" for s in names["segments"]])
    near = reduce(lambda a, b: a | b, [(F.col("high") >= w) & (F.col("low") <= (w + _TOP if begins else w)) for w in words])
    paths = [r.file for r in lists.filter(near).select("file").collect()]  # files that are read
    rows = spark.read.schema(_schema(names)).parquet(*paths) if paths else spark.createDataFrame([], _schema(names))
    return _alive(spark, target, names, rows.filter(_fits(words, begins)))


def bm25(spark: SparkSession, target: str, query: str, limit: int | None = None) -> DataFrame:
    """(key, score) as ``search.bm25`` has it: texts with a term that begins with a word of the query.

    With ``limit`` the best of them, ties by key. Then texts are searched block by block: bounds of the terms in a block
    give the largest score that a text of it can have. The most promising blocks give a score that the last of the best
    has at least, and of the others only those are read whose bound reaches it."""
    names, wanted = versions.read(spark, target), search.words(query)
    if not wanted or not names.get("segments"):
        return _none(spark, names, "score")
    mean = names["words"] / names["texts"] if names["words"] else 1.0
    rows = postings(spark, target, wanted, True, names)
    bounds = _table(spark, target, "bounds", names, _BOUNDS).filter(_fits(wanted, True))
    counted = rows.groupBy("term").agg(F.count("*").alias("df")) if any(d["rows"] for d in names["dead"]) else bounds.groupBy("term").agg(F.sum("n").alias("df"))
    seen = stored(counted, "terms")  # terms that begin with a word of the query
    scored = lambda r: r.join(seen, "term").groupBy("key").agg(X.rounded(F.sum(search.weight(names["texts"], mean)), 6).alias("score"))
    if limit is None:
        return scored(rows)
    blocks = stored(bounds.join(seen, "term").groupBy("segment", "block").agg(F.sum(search.weight(names["texts"], mean)).alias("most")), "blocks")
    first = _in_blocks(rows, blocks.orderBy(F.desc("most"), "segment", "block").limit(max(limit, 1)))
    best = [r.score for r in scored(first).orderBy(F.desc("score"), "key").limit(limit).collect()]
    least = best[-1] - 2e-6 if len(best) == limit and limit else -1.0  # scores are rounded
    return scored(_in_blocks(rows, blocks.filter(F.col("most") >= least))).orderBy(F.desc("score"), "key").limit(limit)


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Postings in the given blocks; few blocks' numbers reach the scan."""
    n = blocks.count()
    if n <= FEW:
        rows = rows.filter(F.col("block").isin([r.block for r in blocks.select("block").distinct().collect()]))
    return rows.join(_few(blocks.select("segment", "block"), n), ["segment", "block"], "left_semi")


def alternatives(query: str) -> list[tuple[list[tuple[str, ...]], list[tuple[str, ...]]]]:
    """What a query asks for: alternatives between ``or``; of each the phrases, a word being one of one word, that must be in a
    text, and those that must not (with a minus sign). Quoted text is a phrase, and so is a word with marks in it.
    Operands without a letter or digit say nothing."""
    out: list[tuple[list, list]] = [([], [])]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', query.lower()):
        if plain == "or" and not minus:
            out.append(([], []))
            continue
        phrase = tuple(re.findall(r"[^\W_]+", quoted or plain))
        if phrase:
            out[-1][bool(minus)].append(phrase)
    return [a for a in out if a[0] or a[1]]


def match(spark: SparkSession, target: str, query: str, limit: int | None = None) -> DataFrame:
    """(key, rank): texts that fit the query (see ``alternatives``), the best first if there is a limit, ties by key.

    The rank is the sum over covers, the shortest spans of a text in which an alternative that it fits has all it asks
    for, of COVER / (1 + words in the span that no phrase asked for has). Texts that fit by what they lack alone have
    rank 0. Postings are joined by text first, texts that lack a word leave, and phrases and covers are found by the
    order of positions."""
    names, asked = versions.read(spark, target), alternatives(query)
    if not asked or not names.get("segments"):
        return _none(spark, names, "rank")
    phrases = sorted({p for a in asked for side in a for p in side})
    positive = sorted({w for must, _ in asked for p in must for w in p})
    lacking = any(not must for must, _ in asked)  # an alternative may fit texts without any of the words
    rows = postings(spark, target, sorted({w for p in phrases for w in p}), False, names)
    texts = rows.groupBy("key").agg(F.collect_list(F.struct("term", "positions")).alias("found"))  # no more than the query's words
    if not lacking:
        has = lambda w: F.exists("found", lambda x: x["term"] == w)
        every = lambda ps: reduce(lambda a, b: a & b, [has(w) for p in ps for w in p])
        texts = texts.filter(reduce(lambda a, b: a | b, [every(must) for must, _ in asked]))
    each = texts.select("key", F.explode("found").alias("x")).select("key", "x.term", F.explode("x.positions").alias("position"))

    order = Window.partitionBy("key").orderBy("position")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = Window.partitionBy("key")
    each = each.withColumn("nth", F.sum(F.col("term").isin(positive).cast("int")).over(before))
    starts = {}
    for i, p in enumerate(phrases):
        last = [F.lag("term", k).over(order).eqNullSafe(F.lit(w)) & F.lag("position", k).over(order).eqNullSafe(F.col("position") - k) if k else F.col("term") == w for k, w in enumerate(reversed(p))]
        starts[f"s{i}"] = F.when(reduce(lambda a, b: a & b, last), F.struct((F.col("position") - (len(p) - 1)).alias("at"), (F.col("nth") - (len(p) - 1)).alias("nth")))
    each = each.withColumns(starts)
    at = {p: F.col(f"l{i}") for i, p in enumerate(phrases)}
    there = {p: F.col(f"t{i}") for i, p in enumerate(phrases)}
    each = each.withColumns({f"l{i}": F.last(f"s{i}", ignorenulls=True).over(before) for i in range(len(phrases))} | {f"t{i}": F.max(F.col(f"s{i}").isNotNull()).over(text) for i in range(len(phrases))})
    every = lambda cs: reduce(lambda a, b: a & b, cs, F.lit(True))
    fits = [every([there[p] for p in must] + [~there[p] for p in not_]) for must, not_ in asked]
    spans = [F.when(f & every([at[p].isNotNull() for p in must]), F.least(*[at[p] for p in must], at[must[0]])) for f, (must, _) in zip(fits, asked, strict=True) if must]
    none = F.lit(None).cast("struct<at:int,nth:bigint>")
    each = each.withColumn("span", F.greatest(*spans, none, none)).withColumn("fits", reduce(lambda a, b: a | b, fits))
    fresh = F.col("span").isNotNull() & (F.lag("span.at").over(order).isNull() | (F.lag("span.at").over(order) < F.col("span.at")))
    other = F.col("position") - F.col("span.at") - (F.col("nth") - F.col("span.nth"))
    each = each.withColumn("part", F.when(fresh, COVER / (1 + other)))
    out = each.groupBy("key").agg(F.max("fits").alias("fits"), F.sum("part").alias("rank"))
    if lacking:
        everything = _alive(spark, target, names, _table(spark, target, "texts", names, f"segment string, key {names['key']}, length int"))
        out = everything.select("key").join(out, "key", "left").withColumn("fits", F.coalesce("fits", F.lit(True)))
    out = out.filter("fits").select("key", X.rounded(F.coalesce("rank", F.lit(0.0)), 6).alias("rank"))
    return out if limit is None else out.orderBy(F.desc("rank"), "key").limit(limit)


def indexed(df: DataFrame, key: str, text: str) -> str:
    """The folder of a new index of a table's texts."""
    target = scratch(df.sparkSession, "index")
    append(df.sparkSession, target, df, key, text)
    return target
