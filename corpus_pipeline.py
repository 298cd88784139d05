"""The corpus pipeline: five stages, each applying one operator to all documents that the stage before it kept.

Stages take (spark, docs, sf_dir) and return documents again (doc_id, text, lang, source, n_chars), but for the last,
which returns each kept document's token ids. Null and empty texts pass every stage that has nothing to judge in them;
extra columns of documents stay up to the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlattice.llm import decontaminate, jaccard, quality, sentence_pieces, substrings, vocab
from bidlattice.session import prepare, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained classifier calls low in quality or toxic."""
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document of smallest id.

    Null ids count as the largest: of a group of null ids alone one document stays, of other groups none of them does.
    Documents without words stay; rows of a group that share its smallest id all stay. Rows are told apart by id, and by
    their set of shingles too where an id is null or has rows that stay and rows that go."""
    found = stored(jaccard.grouped(docs, jaccard.SHINGLE, jaccard.SIMILARITY).select("doc_id", "set", "root", "component_id"), "grouped")
    stays = F.col("doc_id") == F.col("component_id")
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_and(stays).alias("all"), F.bool_or(stays).alias("any"))
    ids = stored(ids.filter("any"), "kept")
    sure = docs.join(jaccard.small(ids.filter("all").select("doc_id")), "doc_id", "left_semi").select(docs.columns)

    mixed = jaccard.small(ids.filter("not all").select("doc_id"))
    sets = found.join(mixed, "doc_id", "left_semi").filter(stays).select(F.col("doc_id").alias("id"), F.col("set").alias("one")).distinct()
    some = jaccard.with_set(docs.join(mixed, "doc_id", "left_semi").select(docs.columns))
    some = some.join(sets, (F.col("doc_id") == F.col("id")) & F.col("set").eqNullSafe(F.col("one")), "left_semi").select(docs.columns)

    nulls = jaccard.with_set(docs.filter("doc_id is null"))
    heads = found.filter("doc_id is null and component_id is null and set is not null").groupBy("root").agg(F.min("set").alias("set")).select("set")
    whole = F.struct(*docs.columns)
    copies = nulls.join(heads, "set", "left_semi").groupBy("set").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return sure.unionByName(some).unionByName(nulls.filter("set is null").select(docs.columns)).unionByName(copies)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words or more that also stand earlier; a document of which no word is left goes."""
    found = substrings.without_repeats(docs)
    found = found.filter("n_removed = 0 or n_removed < n_words")
    found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row, or a whole shorter item, with the benchmark."""
    hit = decontaminate.hit_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hit.filter(F.size("hit_spans") == 0).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document: SentencePiece ids with begin and end."""
    return sentence_pieces.encode_decode(docs, vocab.public(sentence_pieces.MODEL)).drop("decoded")


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("sentence_pieces", encode_pieces),
]

#: A trained classifier has no SQL; the later stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
