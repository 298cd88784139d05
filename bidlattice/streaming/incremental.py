"""Loads into a stored graph, by streams that resume from their checkpoint and by pages of keys, and windowed counts of late events.

A stored graph is a folder of base and change files, by load, kind and bucket of the key, which a manifest of each
version names. A load writes the rows that it changes; readers take the last of each key; ``compact`` folds changes into
new base files of their buckets."""

from __future__ import annotations

import functools
import json
import re
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import store
from ..operators.views import Graph
from ..plans.schema import ENTITY, HISTORY, RELATION
from ..sources.files import Delta, relational
from . import versions


BUCKETS = 8  # of a kind's rows, by their key; fixed when a store is made
KEPT = 64  # last loads whose keys a commit is compared with; a load that began before those is made anew
ATTEMPTS = 20
_KEY = {"entities": "uid", "relations": "id"}


def import_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, to_delta: Callable[[DataFrame], Delta], now: str, fmt: str = "parquet") -> int:
    """Loads all files that have come to ``source`` since the last call into the graph at ``target``; returns its version.

    Each micro-batch is one load. Which batch of which source was loaded last is in the manifest, under the id that the
    checkpoint has, so a batch that runs again after a crash does nothing if its load was committed and all of it
    otherwise, whatever other sources, pages or writers the graph has. A new checkpoint is a new source: its files are
    loaded again, which changes no more than loading them twice does."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        name = json.loads(versions.text(spark, f"{checkpoint}/metadata"))["id"]
        if batch_id > versions.read(spark, target).get("sources", {}).get(name, -1):
            append(spark, target, to_delta(batch), now, more={"sources": {name: batch_id}})

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return version(spark, target)


class Prepared(NamedTuple):
    """A load whose files are written and that no version names yet: the version it was made on, its id, the rows of each
    part of its tables (``kind=K/bucket=b``), the keys that it rests on, and what the manifest says of it."""

    base: int
    load: str
    parts: dict[str, dict[str, int]]
    reads: DataFrame
    names: dict


def create(spark: SparkSession, target: str, buckets: int = BUCKETS) -> None:
    """Makes an empty stored graph with a number of buckets of its own, for a bucket to be what one executor folds at a time.
    A first load makes one with BUCKETS."""
    versions.commit(spark, target, 1, {"buckets": buckets})


def prepare(spark: SparkSession, target: str, delta: Delta, now: str, changed_by: str = "import") -> Prepared:
    """Merges a delta with what it meets of the graph at ``target``, and writes the rows that change, and those alone, as change
    files by kind and bucket of the key: what is written grows with the delta, not with the graph."""
    began = time.monotonic()
    before = versions.read(spark, target)
    base, buckets = before.get("version", 0), before.get("buckets", BUCKETS)
    load = f"{base + 1:08d}-{uuid.uuid4().hex}"  # later loads of a key sort after it
    whole = _graph(spark, target, before, now)
    names, ids = store.wanted(delta.entities, delta.relations)
    here = store.relevant(whole, names, ids) if base else whole
    largest = functools.cache(lambda kind: whole.nodes(kind).agg(F.max(F.substring_index("uid", "-", -1).cast("long"))).first()[0] or 0)
    taken = lambda kind: bool(versions.listed(spark, f"{target}/leases/{kind}"))
    reserve = lambda kind, n: versions.lease(spark, f"{target}/leases", kind, n, 0 if taken(kind) else largest(kind))
    m = store.load(here, delta.entities, delta.relations, now, changed_by, 0, reserve)
    written = lambda r: r.select("id", F.xxhash64("confidence", "source", "valid_from", "valid_to").alias("h"))
    fresh = written(m.relations).join(written(here.relations), ["id", "h"], "left_anti")
    changed = {"entities": m.entities.join(m.touched, "uid", "left_semi"), "relations": m.relations.join(fresh.select("id"), "id", "left_semi")}
    parts, rows = {}, {}
    for table, df in changed.items():
        parts[table], rows[table] = _write(df, f"{target}/{table}/load={load}", _KEY[table], buckets, ENTITY if table == "entities" else RELATION)
    for table, df, schema in (("history", m.history, HISTORY), ("rejected", m.rejected, store.REJECTED)):
        df.write.parquet(f"{target}/{table}/{load}")
        rows[table] = spark.read.schema(schema).parquet(f"{target}/{table}/{load}")
    keys = _keys(rows["entities"].unionByName(here.entities.join(m.touched, "uid", "left_semi")), rows["relations"])
    keys.coalesce(1).write.parquet(f"{target}/touched/{load}")
    rests = names.select(F.concat_ws("|", "kind", "canonical_name").alias("key")).unionByName(ids.select(F.concat_ws("|", F.lit("id"), "id").alias("key")))
    rests = rests.unionByName(spark.read.schema("key string").parquet(f"{target}/touched/{load}")).unionByName(spark.createDataFrame([("alias",)], "key string"))
    said = {"changes": sum(parts["entities"].values()), "as_of": now, "load": store.counts(here, rows["entities"], rows["relations"], rows["rejected"])}
    return Prepared(base, load, parts, rests, said | {"buckets": buckets, "seconds": round(time.monotonic() - began, 3)})


def _write(df: DataFrame, path: str, key: str, buckets: int, schema: str) -> tuple[dict[str, int], DataFrame]:
    """Writes rows by kind and bucket, into files of even size, and gives the number of rows of each, and the rows."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).hint("rebalance", "kind", "bucket")
    rows.sortWithinPartitions("kind", "bucket", key).write.partitionBy("kind", "bucket").parquet(path)
    back = df.sparkSession.read.schema(f"{schema}, bucket int").parquet(path)
    count = {f"kind={r.kind}/bucket={r.bucket}": r["count"] for r in back.groupBy("kind", "bucket").count().collect()}  # kinds x buckets
    return count, back.select(df.columns)


def _keys(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(key): what another load may rest on: names and scraper ids of entities, ids of edges, and one key for all aliases."""
    e = entities.select(F.explode(F.array(F.concat_ws("|", "kind", "canonical_name"), F.concat(F.lit("id|"), X.truthy(F.col("attributes")["scraper_id"])), F.when(F.col("kind") == "company_alias", F.lit("alias")))).alias("key"))
    r = relations.select(F.explode(F.array(F.concat(F.lit("edge|"), "id"), F.when(F.col("kind") == "alias_of", F.lit("alias")))).alias("key"))
    return e.unionByName(r).filter("key is not null").distinct()


def commit(spark: SparkSession, target: str, p: Prepared, more: dict[str, dict] | None = None) -> dict | None:
    """Makes a prepared load the next version, and returns what that names; null if a load that was committed meanwhile
    changed what this one rests on. ``more``: dictionaries of the manifest that it adds to.

    Loads that touch other keys need nothing done again: their files stand side by side."""
    while True:
        before = versions.read(spark, target)
        if before.get("version", 0) != p.base:
            meanwhile = [load for n, load in before.get("loads", []) if n > p.base]
            if p.base < before["version"] - KEPT:
                return None
            others = [f"{target}/touched/{load}" for load in meanwhile]
            if others and spark.read.schema("key string").parquet(*others).join(p.reads, "key", "left_semi").limit(1).count():
                return None
        number = before.get("version", 0) + 1
        names = dict(before) | {"buckets": p.names["buckets"], "as_of": p.names["as_of"], "load": p.names["load"], "seconds": p.names["seconds"], "changes": before.get("changes", 0) + p.names["changes"]}
        for table, parts in p.parts.items():
            known = {k: list(v) for k, v in before.get(table, {}).items()}
            for part, rows in parts.items():
                known[part] = sorted([*known.get(part, []), [p.load, rows]])
            names[table] = known
        names |= {"history": [*before.get("history", []), [p.load, before.get("changes", 0)]], "rejected": [*before.get("rejected", []), p.load], "loads": [*before.get("loads", []), [number, p.load]][-KEPT:]}
        names |= {k: before.get(k, {}) | v for k, v in (more or {}).items()}
        try:
            versions.commit(spark, target, number, names)
            return names | {"version": number}
        except FileExistsError:
            continue  # another writer was first: compared with it, and the next number is tried


def append(spark: SparkSession, target: str, delta: Delta, now: str, changed_by: str = "import", more: dict[str, dict] | None = None) -> dict:
    """Merges a delta into the graph at ``target`` as its next version, all or nothing; returns what the version names.

    Any number of writers may load at once. New entities get uids from leased ranges, so that no two loads give one
    twice; numbers of a load that was made anew or crashed are not used again. Loads that rest on what another has
    changed meanwhile are merged once more, after it: the order is that of the versions."""
    for _ in range(ATTEMPTS):
        names = commit(spark, target, prepare(spark, target, delta, now, changed_by), more)
        if names is not None:
            return names
    raise RuntimeError(f"{ATTEMPTS} other loads of the same keys came before this one")


def import_tables(spark: SparkSession, target: str, tables: dict[str, DataFrame], now: str, size: int = 20_000) -> dict[str, dict]:
    """Imports relational tables into the graph at ``target``, stage by stage and page by page of ``size`` keys; returns the
    numbers of each stage.

    The last key of each stage's committed pages is in the manifest, so a call after a crash, or with tables that have
    grown, goes on from there. Pages are ranges of the integer key, found by one pass over the keys. Companies, whose
    aliases need the whole table, and buyers are a page each, and loading them again changes nothing."""
    out: dict[str, dict] = {}
    for stage, delta in relational(spark, tables):
        whole = stage in ("companies", "organizations")
        after = None if whole else versions.read(spark, target).get("after", {}).get(stage)
        ends = [None] if whole else pages(tables[stage], "id", after, size)
        for end in ends:
            page_ = delta
            if end is not None:
                df = tables[stage].filter(_after("id", after) & (F.col("id") <= end))
                page_ = dict(relational(spark, {stage: df}))[stage]
                after = end
            names = append(spark, target, page_, now, more=None if end is None else {"after": {stage: end}})
            out[stage] = {k: v + out.get(stage, {}).get(k, 0) for k, v in names["load"].items()}
    return out


def _after(key: str, after: int | None) -> Column:
    return F.col(key).isNotNull() if after is None else F.col(key) > after


def pages(df: DataFrame, key: str, after: int | None, size: int) -> list[int]:
    """The last keys of the pages of ``size`` rows that follow the key ``after``, or of all pages if that is null."""
    rows = store.numbered(df.filter(_after(key, after)).select(F.col(key).cast("long").alias("k")), F.col("k"))
    return [r.last for r in rows.groupBy(F.floor(F.col("n") / size).alias("page")).agg(F.max("k").alias("last")).orderBy("page").collect()]


def version(spark: SparkSession, target: str) -> int:
    """The number of the last version, 0 before the first."""
    return max(versions.numbers(spark, target), default=0)


def current(spark: SparkSession, target: str, as_of: str = "1970-01-01") -> Graph:
    """The graph of the last version, empty before the first; a filter on kind opens that kind's files alone."""
    return _graph(spark, target, versions.read(spark, target), as_of)


def _graph(spark: SparkSession, target: str, names: dict, as_of: str) -> Graph:
    return Graph(*[_folded(spark, target, table, names.get(table, {}), schema) for table, schema in (("entities", ENTITY), ("relations", RELATION))], as_of)


def _folded(spark: SparkSession, target: str, table: str, parts: dict[str, list], schema: str) -> DataFrame:
    """A table's rows: base files, and of keys with changes the last change.

    Parts without changes are read as they are. In others the base rows of changed keys leave, by broadcast of the keys
    while there are few, so that the base isn't shuffled."""
    key = _KEY[table]
    columns = [c.strip().split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(",")]

    def rows(loads: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{target}/{table}/load={load}/{part}" for part, load in loads]
        return spark.read.schema(f"{schema}, load string").option("basePath", f"{target}/{table}").parquet(*paths).select(*columns, "load") if paths else spark.createDataFrame([], f"{schema}, load string")

    base = [(part, loads[0][0]) for part, loads in sorted(parts.items())]
    later = [(part, load) for part, loads in sorted(parts.items()) for load, _ in loads[1:]]
    if not later:
        return rows(base).select(columns)
    folded = rows(later).groupBy("kind", key).agg(F.max_by(F.struct(*[c for c in columns if c not in ("kind", key)]), "load").alias("x")).select("kind", key, "x.*").select(columns)
    several = {part for part, _ in later}
    few = sum(n for part in several for _, n in parts[part][1:]) <= store.BROADCAST_ROWS
    changed = folded.select("kind", key)
    old = rows([b for b in base if b[0] in several]).select(columns).join(F.broadcast(changed) if few else changed, ["kind", key], "left_anti")
    return rows([b for b in base if b[0] not in several]).select(columns).unionByName(old).unionByName(folded)


def compact(spark: SparkSession, target: str, share: float = 0.5, loads: int = 8) -> int:
    """Folds the changes of buckets into new base files, and history and rejected rows of many loads into one file list each;
    returns how many buckets were written.

    A bucket is due when it has changes with more than ``share`` of its base's rows, or of ``loads`` loads or more. Other
    loads may be under way: changes that they commit meanwhile stay changes."""
    before = versions.read(spark, target)
    if not before:
        return 0
    fold, done = f"{before['version']:08d}~{uuid.uuid4().hex}", {}  # sorts after all loads that it holds
    for table, schema in (("entities", ENTITY), ("relations", RELATION)):
        due = {part: own for part, own in before.get(table, {}).items() if len(own) > 1 and (len(own) > loads or sum(n for _, n in own[1:]) > share * own[0][1])}
        rows = _write(_folded(spark, target, table, due, schema), f"{target}/{table}/load={fold}", _KEY[table], before["buckets"], schema)[0] if due else {}
        done[table] = {part: (own, rows[part]) for part, own in due.items()}
    for table, rows in (("history", history(spark, target)), ("rejected", rejected(spark, target))):
        if len(before.get(table, [])) >= loads:
            rows.write.parquet(f"{target}/{table}/{fold}")
            done[table] = before[table]
    if not any(done.values()):
        return 0
    while True:
        now = versions.read(spark, target)
        for table in _KEY:
            for part, (own, rows) in done[table].items():
                now[table][part] = sorted([[fold, rows], *[x for x in now[table][part] if x not in own]])
        for table in ("history", "rejected"):
            if table in done:
                now[table] = [[fold, 0] if table == "history" else fold, *[x for x in now[table] if x not in done[table]]]
        try:
            versions.commit(spark, target, now["version"] + 1, now)
            return sum(len(done[t]) for t in _KEY)
        except FileExistsError:
            continue


def history(spark: SparkSession, target: str) -> DataFrame:
    """(uid, snapshot, changed_by, changed_at, seq) of all loads; ``seq`` numbers changes in their order."""
    loads = dict(versions.read(spark, target).get("history", []))
    if not loads:
        return spark.createDataFrame([], HISTORY)
    first = F.create_map(*[F.lit(x) for load, n in loads.items() for x in (load, n)])  # a load each, fewer once compacted
    rows = spark.read.schema(HISTORY).parquet(*[f"{target}/history/{x}" for x in loads])
    return rows.withColumn("seq", F.col("seq") + first[F.element_at(F.split("_metadata.file_path", "/"), -2)])


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """(seq, kind, name, what) of the rows of all loads that could not be used."""
    loads = versions.read(spark, target).get("rejected", [])
    return spark.read.schema(store.REJECTED).parquet(*[f"{target}/rejected/{x}" for x in loads]) if loads else spark.createDataFrame([], store.REJECTED)


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Deletes manifests before the last ``keep``, and folders that none of those names, such as those of a load that
    crashed; returns how many folders of rows went. No load may be under way."""
    known = versions.numbers(spark, target)
    last = [versions.read(spark, target, n) for n in known[-keep:]]
    gone = 0
    for table in _KEY:
        used = {f"load={load}/{part}" for x in last for part, loads in x.get(table, {}).items() for load, _ in loads}
        for load in (x for x in versions.listed(spark, f"{target}/{table}") if x.startswith("load=")):
            for kind in (x for x in versions.listed(spark, f"{target}/{table}/{load}") if x.startswith("kind=")):
                for bucket in (x for x in versions.listed(spark, f"{target}/{table}/{load}/{kind}") if x.startswith("bucket=")):
                    if f"{load}/{kind}/{bucket}" not in used:
                        versions.delete(spark, f"{target}/{table}/{load}/{kind}/{bucket}")
                        gone += 1
    for table in ("history", "rejected", "touched"):
        used = {load for x in last for load in (x.get("rejected", []) if table == "rejected" else [n[0] for n in x.get("history", [])] if table == "history" else [n[1] for n in x.get("loads", [])])}
        for load in versions.listed(spark, f"{target}/{table}"):
            if load not in used:
                versions.delete(spark, f"{target}/{table}/{load}")
    for n in known[:-keep]:
        versions.delete(spark, f"{target}/versions/v{n:08d}.json")
    for kind in versions.listed(spark, f"{target}/leases"):
        for lease in [x for x in versions.listed(spark, f"{target}/leases/{kind}") if x.isdigit()][:-1]:
            versions.delete(spark, f"{target}/leases/{kind}/{lease}")
    return gone


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, hash) of files whose content is not known by its hash."""
    return files.join(known, ["path", "hash"], "left_anti")


def _watched(events: DataFrame, lateness: str) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", lateness) if events.isStreaming else events


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, events, total) of a stream or table of events; rows later than the watermark are dropped by streams."""
    events = _watched(events, lateness)
    n = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return n.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, events): runs of a user's events without a longer gap."""
    events = _watched(events, lateness)
    n = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return n.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
