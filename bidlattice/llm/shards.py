"""Sharding by size-tiered compaction: small immutable shards, merged runs, versioned manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch

TARGET_BYTES = 128 << 20  # of a merged file
FAN = 4  # files of one tier that are merged, and the ratio of sizes of one tier to the next
ARRIVALS = 4  # in which the registered query deals out its table

_ENTRY = "path string, bytes long, rows long, schema string"


def _path(spark: SparkSession, name: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions, oldest first."""
    fs, at = _path(spark, f"{folder}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v")


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(path, bytes, rows, schema) of each live shard of a version, the last unless given; a row without a path holds the schema."""
    known = versions(spark, folder)
    if not known:
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).parquet(f"{folder}/manifests/v{known[-1] if version is None else version:08d}")


def _commit(spark: SparkSession, folder: str, version: int, entries: DataFrame) -> int:
    """Makes ``entries`` the given version by one rename, which fails if another writer has committed that version."""
    temporary = f"{folder}/manifests/.tmp-{uuid.uuid4().hex}"
    entries.coalesce(1).write.parquet(temporary)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (temporary, f"{folder}/manifests/v{version:08d}"))
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(conf).getUri(), conf)
    context.rename(source, target, none)
    return version


def _listed(spark: SparkSession, run: str, schema: StructType) -> DataFrame:
    """Manifest rows of the files of one written run; files without rows are left out."""
    files = spark.read.schema(schema).parquet(run).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return files.groupBy("path", "bytes").agg(F.count("*").alias("rows")).withColumn("schema", F.lit(None).cast("string"))


def append(arrival: DataFrame, folder: str) -> int:
    """Adds an arrival as new shards, one for each partition it has, and commits; returns the version.

    Files are never changed afterwards. All arrivals have the schema of the first, whatever their columns' names; an
    empty arrival commits a version without new shards. A crash before the commit leaves the last version as it was."""
    spark = arrival.sparkSession
    known = versions(spark, folder)
    old = manifest(spark, folder)
    header = spark.createDataFrame([(None, 0, 0, arrival.schema.json())], _ENTRY)
    if known:
        had = StructType.fromJson(json.loads(old.filter("path is null").first().schema))
        if [(f.name, f.dataType) for f in had] != [(f.name, f.dataType) for f in arrival.schema]:
            raise ValueError("the arrival's columns differ from the first arrival's")
        header = old.filter("path is null")
    run = f"{folder}/data/{uuid.uuid4().hex}"
    arrival.write.parquet(run)
    entries = header.unionByName(old.filter("path is not null")).unionByName(_listed(spark, run, arrival.schema))
    return _commit(spark, folder, (known[-1] if known else 0) + 1, entries)


def _schema(entries: DataFrame) -> StructType:
    return StructType.fromJson(json.loads(entries.filter("path is null").first().schema))


def tiers(entries: DataFrame, target: int, fan: int) -> DataFrame:
    """Shards below half the target with their tier: 0 for a target's ``fan``-th to half, 1 for the next ``fan``-th part, ..."""
    small = entries.filter(F.col("path").isNotNull() & (F.col("bytes") < target // 2))
    return small.withColumn("tier", F.floor(F.log(float(fan), F.lit(float(target)) / F.greatest("bytes", F.lit(1)))).cast("int"))


def compact(spark: SparkSession, folder: str, target: int = TARGET_BYTES, fan: int = FAN) -> int:
    """Merges runs of similar size until no tier holds ``fan`` shards; each round commits a version. Returns the last.

    A round takes every tier with at least ``fan`` shards. One session setting makes Spark pack whole files into read
    partitions of the target size, so a merge needs no shuffle: each task reads its files and writes one. Rows of
    replaced shards appear once in any version, and old versions stay readable until ``vacuum``."""
    packed = spark.newSession()
    packed.conf.set("spark.sql.files.maxPartitionBytes", str(target))
    packed.conf.set("spark.sql.files.openCostInBytes", "0")
    packed.conf.set("spark.sql.files.minPartitionNum", "1")
    while True:
        version = versions(spark, folder)[-1]
        entries = manifest(spark, folder, version)
        ready = tiers(entries, target, fan)
        full = ready.groupBy("tier").count().filter(F.col("count") >= fan).select("tier")
        merged = ready.join(F.broadcast(full), "tier", "left_semi").select("path")  # tiers are few: logarithms of sizes
        paths = [r.path for r in merged.collect()]
        if not paths:
            return version
        schema, run = _schema(entries), f"{folder}/data/{uuid.uuid4().hex}"
        packed.read.schema(schema).parquet(*paths).write.parquet(run)
        kept = entries.join(merged, "path", "left_anti").select(entries.columns)
        added = _listed(spark, run, schema)
        before, after = len(paths), added.count()
        _commit(spark, folder, version + 1, kept.unionByName(added))
        if after >= before:  # already as few files as this target allows
            return version + 1


def current(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """All rows of a version."""
    entries = manifest(spark, folder, version)
    paths = [r.path for r in entries.filter("path is not null").select("path").collect()]
    schema = _schema(entries)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Deletes all versions but the last ``keep`` and the data files that none of those names; returns how many files went."""
    known = versions(spark, folder)
    live = {r.path for v in known[-keep:] for r in manifest(spark, folder, v).filter("path is not null").select("path").collect()}
    live = {p.split("/data/")[-1] for p in live}
    for v in known[:-keep]:
        fs, at = _path(spark, f"{folder}/manifests/v{v:08d}")
        fs.delete(at, True)
    fs, top = _path(spark, f"{folder}/data")
    gone = 0
    for run in fs.listStatus(top):
        for file in fs.listStatus(run.getPath()):
            name = f"{run.getPath().getName()}/{file.getPath().getName()}"
            if file.getPath().getName().startswith("part-") and name not in live:
                gone += bool(fs.delete(file.getPath(), False))
    return gone


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents dealt into arrivals by ranges of doc_id, appended one by one, compacted, and read back from the last manifest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "shards")
    bounds = docs.agg(F.percentile_approx("doc_id", [k / ARRIVALS for k in range(1, ARRIVALS)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    for k in range(len(bounds) + 1):
        low = F.col("doc_id") >= bounds[k - 1] if k else F.lit(True)
        high = F.col("doc_id") < bounds[k] if k < len(bounds) else F.lit(True)
        append(docs.filter(low & high | F.col("doc_id").isNull() & F.lit(k == 0)), folder)
    compact(spark, folder)
    return current(spark, folder).select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = "select doc_id, lang, source, cast(octet_length(encode(text)) as bigint) as n_bytes, sha256(text) as text_sha256 from documents"
