"""Token ids as flat binary files with 64-bit document offsets, read back through memory maps."""

from __future__ import annotations

import json
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch
from . import pieces, vocab, words

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
PART_BYTES = 64 << 20  # of text that go into one part, about
FILE_BYTES = 128 << 20  # of ids in one file: a part with very many equal ids has several


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(fs, path: str, data) -> None:
    """Writes a file as a whole: a task that runs twice writes the same bytes, and readers see either none or all."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        for x in data:
            f.write(x)
    fs.move(temporary, path)


def encode(docs: DataFrame, path: str, end_id: int, dtype: str, doc_id: str = "doc_id", text: str = "text", bounds: list | None = None) -> DataFrame:
    """(doc_id, part, ids): ids of each text as little-endian bytes of ``dtype``, ``end_id`` last, and the number of
    ``bounds`` that are not above the id."""
    limits = np.array(bounds or [], np.int64)

    def run(batches):
        table = vocab.fast_table(path)
        for s in words.slices(batches):
            found, at = pieces.split(s.data, s.offsets, vocab.BREAKS, vocab.MARKS)
            ids, offsets = pieces.gather(*table.look_up(found))
            begin, n = offsets[at], len(s.ids)
            out = np.empty(len(ids) + n, dtype)
            last = begin[1:] + np.arange(n)
            inner = np.ones(len(out), bool)
            inner[last] = False
            out[last], out[inner] = end_id, ids
            size = np.dtype(dtype).itemsize
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, (last + 1) * size).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            key = s.ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(np.searchsorted(limits, key, "right").astype(np.int32)), column], ["doc_id", "part", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, part int, ids binary")


class TokenFiles(NamedTuple):
    """A written set of token files: folder, dtype, and (name, documents, tokens, base) of each part."""

    folder: str
    dtype: str
    parts: list


def write(docs: DataFrame, path: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> TokenFiles:
    """Encodes all texts and writes, in ascending id order, ``part-N-K.bin`` (ids), ``part-N-K.off`` (64-bit offsets of
    documents in the file, one more than documents) and ``part-N-K.doc`` (64-bit ids), then ``manifest.json``.

    Ids are 16-bit where the vocabulary allows it, else 32-bit. Rows go to parts by quantiles of the id, so the order
    is total without one task seeing all; a part's base is the prefix sum of token counts of the parts before it.
    A null text is empty: the end id alone. Null ids come first and are written as the smallest 64-bit integer; rows
    with equal ids stand together in the order of their ids' bytes. The manifest is written last: a folder without it is not complete."""
    spark = docs.sparkSession
    prepare(spark)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(F.col(text).cast("string")).alias("n"))
    total = ids.agg(F.sum("n"), F.count("*")).first()
    n_parts = max(1, spark.sparkContext.defaultParallelism, -(-(total[0] or 0) // part_bytes)) if total[1] else 1
    bounds = sorted({int(x) for x in ids.agg(F.percentile_approx("doc_id", [k / n_parts for k in range(1, n_parts)], 100 * n_parts)).first()[0] or []}) if n_parts > 1 else []
    size = vocab.fast_tokenizer(path).get_vocab_size(True)
    dtype = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    coded = encode(docs, path, end_id, dtype, doc_id, text, bounds).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")

    def put(batches):
        fs, top = _place(folder)
        part, file, size, ids, keys, ends = None, 0, 0, [], [], [0]

        def flush():
            name = f"part-{part:08d}-{file:04d}"
            _put(fs, f"{top}/{name}.bin", ids)
            _put(fs, f"{top}/{name}.off", [np.array(ends, "<i8").tobytes()])
            _put(fs, f"{top}/{name}.doc", [np.array(keys, "<i8").tobytes()])
            return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "documents": [len(keys)], "tokens": [ends[-1]]}, schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))

        for b in batches:
            for p, k, x in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if p != part or size > FILE_BYTES:
                    if part is not None:
                        yield flush()
                    part, file, size, ids, keys, ends = p, file + 1 if p == part else 0, 0, [], [], [0]
                ids.append(x)
                size += len(x)
                keys.append(np.iinfo(np.int64).min if k is None else k)
                ends.append(ends[-1] + len(x) // np.dtype(dtype).itemsize)
        if part is not None:
            yield flush()

    fs, top = _place(folder)
    fs.create_dir(top, recursive=True)
    parts, base = [], 0
    for r in sorted(coded.mapInArrow(put, "part int, file int, documents long, tokens long").collect()):
        parts.append([f"part-{r.part:08d}-{r.file:04d}", r.documents, r.tokens, base])
        base += r.tokens
    _put(fs, f"{top}/manifest.json", [json.dumps({"dtype": dtype, "tokens": base, "end_id": end_id, "parts": parts}).encode()])
    return TokenFiles(folder, dtype, parts)


def opened(folder: str) -> TokenFiles:
    """The files of a complete folder."""
    fs, top = _place(folder)
    with fs.open_input_file(f"{top}/manifest.json") as f:
        said = json.loads(f.read())
    return TokenFiles(folder, said["dtype"], said["parts"])


def _array(fs, path: str, dtype: str) -> np.ndarray:
    """The file's integers, memory-mapped where the file system is local."""
    if not fs.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(spark: SparkSession, files: TokenFiles, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in ``files``: start counts the ids of all documents before."""
    prepare(spark)
    folder, dtype = files.folder, files.dtype

    def run(batches):
        fs, top = _place(folder)
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                ids, ends, keys = (_array(fs, f"{top}/{name}.{x}", d) for x, d in (("bin", dtype), ("off", "<i8"), ("doc", "<i8")))
                for lo in range(0, len(keys), 1000):
                    hi = min(lo + 1000, len(keys))
                    own = [ids[a:e] for a, e in zip(ends[lo:hi].tolist(), ends[lo + 1 : hi + 1].tolist(), strict=True)]
                    columns = [pa.array(keys[lo:hi], pa.int64(), mask=keys[lo:hi] == np.iinfo(np.int64).min), pa.array(base + ends[lo:hi]), pa.array(np.diff(ends[lo : hi + 1]))]
                    columns.append(pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()))
                    if keep_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    parts = spark.createDataFrame([(p[0], p[3]) for p in files.parts], "name string, base long")
    parts = parts.repartition(max(1, min(len(files.parts), 4 * spark.sparkContext.defaultParallelism)))
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(spark, write(docs, vocab.public(TOKENIZER), END_ID, scratch(spark, "tokens")), keep_ids=False)
