"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import pieces, vocab, words

MODEL = "piece_bpe_32k.model"


def crosses_markers(model) -> bool:
    """Whether a piece of the model has a space marker after another character, or its normaliser changes text."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    norm = proto.normalizer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    return not plain or any("▁" in p.piece.lstrip("▁") or p.type == 4 for p in proto.pieces)


def _encode(model, table, s, whole: bool):
    """Ids of each text of a slice without begin and end: the joined ids and n + 1 offsets."""
    if whole:
        ids = [np.array(x, "<u4") for x in model.encode([s.data[a:b].tobytes().decode() for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)], num_threads=1)]
        return np.concatenate([*ids, np.zeros(0, "<u4")]), np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)
    # A piece that is not the first of its text begins with a space, which the model's own prefix stands for.
    mark = np.zeros(len(s.data) + 1, bool)
    mark[pieces.cuts(s.data, s.offsets)] = True
    at = np.flatnonzero(mark)
    begins = np.union1d(at, s.offsets[:-1])
    inner = mark[begins] & (begins < len(s.data))
    ends = np.append(begins[1:], len(s.data)) if len(begins) else begins
    starts = begins + inner
    bounds = np.searchsorted(begins, s.offsets)
    # Leaving out the spaces, pieces are consecutive in the remaining bytes.
    keep = np.ones(len(s.data), bool)
    keep[begins[inner]] = False
    size = np.cumsum(ends - starts)
    data = s.data[keep]
    array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, size).astype(np.int64)), pa.py_buffer(data)) if len(starts) else pa.array([], pa.large_string())
    values, places = table.look_up(array)
    ids, offsets = pieces.gather(values, places)
    return ids, offsets[bounds]


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each row: ids with begin and end, and their decoding.

    Where no piece crosses a space marker, each distinct marked word is segmented once and ids are joined back by
    position; for other models texts are encoded whole. Decoding is the library's own on each document's ids. No shuffle.
    A null text is empty: its ids are begin and end. Hashes are of little-endian 32-bit ids and of UTF-8."""
    prepare(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        model, table = vocab.sentencepiece_model(path), vocab.sentencepiece_table(path)
        whole = vocab._once(("crosses", path), lambda: crosses_markers(model))
        begin, end = model.bos_id(), model.eos_id()
        for s in words.slices(batches):
            ids, at = _encode(model, table, s, whole)
            n = len(s.ids)
            out = np.empty(len(ids) + 2 * n, "<u4")
            first = at[:-1] + 2 * np.arange(n)
            last = at[1:] + 2 * np.arange(n) + 1
            inner = np.ones(len(out), bool)
            inner[first], inner[last] = False, False
            out[first], out[last], out[inner] = begin, end, ids
            listed = [out[a : b + 1].tolist() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            decoded = model.decode(listed, num_threads=1)
            columns = [
                s.ids,
                pa.array(last - first + 1, pa.int64()),
                pa.array([hashlib.sha256(out[a : b + 1]).hexdigest() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(listed, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, vocab.public(MODEL), keep_ids=False)
