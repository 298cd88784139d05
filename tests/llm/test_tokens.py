import hashlib
import zlib

import numpy as np
import pytest

from bidlattice.llm import sentence_pieces, token_counts, token_files, vocab
from bidlattice.session import scratch

from .cases import TEXTS, documents


def test_token_counts_equal_the_library(spark):
    path = vocab.public(token_counts.TOKENIZER)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(documents(spark), path).collect()}
    tokenizer = vocab.fast_tokenizer(path)
    assert got == {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}


def test_token_counts_of_no_rows(spark):
    assert token_counts.token_counts(documents(spark, []), vocab.public(token_counts.TOKENIZER)).count() == 0


def test_sentence_pieces_equal_the_library(spark):
    path = vocab.public(sentence_pieces.MODEL)
    model = vocab.sentencepiece_model(path)
    for r in sentence_pieces.encode_decode(documents(spark), path).collect():
        ids = model.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == model.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


@pytest.mark.parametrize(("part_bytes", "file_bytes"), [(1 << 20, 1 << 20), (500, 1 << 20), (1 << 20, 300)])
def test_token_files_round_trip(spark, monkeypatch, part_bytes, file_bytes):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    path = vocab.public(token_files.TOKENIZER)
    tokenizer = vocab.fast_tokenizer(path)
    files = token_files.write(documents(spark), path, token_files.END_ID, scratch(spark, "t"), part_bytes=part_bytes)
    assert token_files.opened(files.folder) == files
    start = 0
    for r in token_files.read(spark, files).orderBy("doc_id").collect():
        ids = [*tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert start == sum(p[2] for p in files.parts)


def test_token_files_of_null_ids_repeats_and_no_rows(spark):
    path = vocab.public(token_files.TOKENIZER)
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "d e f"), (1, None)], "doc_id long, text string")
    rows = token_files.read(spark, token_files.write(docs, path, 1, scratch(spark, "t"))).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 3, 3] and [r.n_tokens for r in rows] == [3, 1, 2, 4]
    empty = token_files.write(docs.limit(0), path, 1, scratch(spark, "t"))
    assert token_files.read(spark, empty).count() == 0
