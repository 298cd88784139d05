"""Versions of a set of files: manifests that name them, committed by one rename each; and leases of numbers."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The committed versions, in order."""
    at, fs = _fs(spark, f"{folder}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(m[1]) for m in (re.fullmatch(r"v(\d{8})\.json", n) for n in names) if m)


def text(spark: SparkSession, path: str) -> str | None:
    """What a small file holds, or null if there is none."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    out = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    stream.close()
    return out


def put(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """Makes a small file, all of it at once, unless there is one of that name: then false. Of several writers one succeeds.

    It is written under another name and renamed without overwriting, which file systems decide for one writer."""
    last, fs = _fs(spark, f"{folder}/{name}")
    at, _ = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = fs.create(at, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)
    try:
        context.rename(fs.makeQualified(at), fs.makeQualified(last), none)
        return True
    except Py4JJavaError as e:
        fs.delete(at, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def read(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """What the last version, or the given one, names; nothing before the first."""
    known = numbers(spark, folder)
    return json.loads(text(spark, f"{folder}/versions/v{known[-1] if number is None else number:08d}.json")) if known else {}


def commit(spark: SparkSession, folder: str, number: int, names: dict) -> None:
    """Makes ``names`` version ``number``: readers see all of it or nothing. An error if another writer has made that version."""
    if not put(spark, f"{folder}/versions", f"v{number:08d}.json", json.dumps(names | {"version": number})):
        raise FileExistsError(f"version {number} of {folder} is there already")


def lease(spark: SparkSession, folder: str, what: str, n: int, least: int = 0) -> int:
    """The first of ``n`` numbers that no other call has got or gets: after all leased ones, and after ``least``."""
    while True:
        names = [x for x in listed(spark, f"{folder}/{what}") if x.isdigit()]
        last = max(int(text(spark, f"{folder}/{what}/{names[-1]}")) if names else 0, least)
        if put(spark, f"{folder}/{what}", f"{last + 1:012d}", str(last + n)):
            return last + 1


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, none if there is no such folder."""
    at, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
