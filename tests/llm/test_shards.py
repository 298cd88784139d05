import pytest
from pyspark.sql import functions as F

from bidlattice.llm import shards
from bidlattice.session import scratch

from .cases import documents


def rows(df):
    return sorted(map(repr, df.collect()))


def test_appends_compact_to_fewer_files_with_the_same_rows(spark):
    folder = scratch(spark, "shards")
    docs = documents(spark).withColumn("path", F.lit("clash")).withColumn("bytes", F.lit(1))
    for k in range(3):
        shards.append(docs.repartition(3), folder)
    shards.append(docs.limit(0), folder)
    many = shards.manifest(spark, folder).filter("path is not null").count()
    version = shards.compact(spark, folder, target=1 << 20, fan=2)
    assert shards.versions(spark, folder)[-1] == version > 4
    few = shards.manifest(spark, folder).filter("path is not null")
    assert few.count() == 1 < many and few.first().rows == 3 * docs.count()
    assert rows(shards.current(spark, folder)) == rows(docs.unionAll(docs).unionAll(docs))
    assert rows(shards.current(spark, folder, 1)) == rows(docs)
    assert shards.vacuum(spark, folder) >= many and rows(shards.current(spark, folder)) == rows(docs.unionAll(docs).unionAll(docs))


def test_two_writers_of_one_version_and_another_schema(spark):
    folder = scratch(spark, "shards")
    docs = documents(spark)
    shards.append(docs.limit(0), folder)
    assert shards.current(spark, folder).count() == 0
    with pytest.raises(Exception, match="v00000001"):
        shards._commit(spark, folder, 1, shards.manifest(spark, folder))
    with pytest.raises(ValueError):
        shards.append(docs.select("doc_id"), folder)


def test_tiers_hold_similar_sizes(spark):
    entries = spark.createDataFrame([("a", 100, 1, None), ("b", 30, 1, None), ("c", 8, 1, None), ("d", 900, 1, None), (None, 0, 0, "{}")], shards._ENTRY)
    assert {r.path: r.tier for r in shards.tiers(entries, 1000, 4).collect()} == {"a": 1, "b": 2, "c": 3}
