"""Token counts: how many tokens each text has, without keeping the tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import pieces, vocab, words

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of ``docs``: UTF-8 bytes, and tokens of the tokenizers file at ``path``.

    Arrow batches are cut into slices of equal bytes, long texts at places no token crosses; each distinct piece of
    a worker is encoded once and only its length is kept. No shuffle.
    A null text counts as empty: 0 and 0. A null id, a repeated row or any other column passes through as it is."""
    prepare(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        table = vocab.fast_table(path, lengths=True)
        for s in words.slices(batches):
            found, bounds = pieces.split(s.data, s.offsets, vocab.BREAKS, vocab.MARKS)
            values, places = table.look_up(found)
            total = np.zeros(len(places) + 1, np.int64)
            np.cumsum(np.array(values, np.int64)[places], out=total[1:])
            yield pa.RecordBatch.from_arrays(
                [s.ids, pa.array(np.diff(s.offsets).astype(np.int64)), pa.array(np.diff(total[bounds]))], ["doc_id", "n_bytes", "n_tokens"]
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, vocab.public(TOKENIZER)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
