"""Full-text search over a table's texts: BM25 of prefix terms joined by or, and pattern search on names. ``text_index`` has
the same over a stored index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .store import alias_map
from .views import Graph

K1, B = 1.2, 0.75


def terms(text: str) -> Column:
    """The words of a text in their order: lower-cased runs of letters and digits; none of null."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(query: str) -> list[str]:
    """The distinct words of a query."""
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def weight(n_texts: int, mean: float, tf="tf", length="length") -> Column:
    """BM25's part of one term (with ``df``) in one text."""
    idf = F.log(1 + (F.lit(float(n_texts)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / mean))


def bm25(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score): texts with a term that begins with a word of the query, by BM25 over all texts.

    Only terms that match leave the scan; the number of texts and their mean length come from one small aggregate."""
    wanted = words(query)
    if not wanted:
        return df.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).limit(0)
    base = df.select(F.col(key).alias("key"), terms(text).alias("terms")).withColumn("length", F.size("terms"))
    total = base.agg(F.count("*").alias("n_texts"), F.avg("length").alias("mean")).first()
    begins = lambda t: F.greatest(*[t.startswith(w).cast("int") for w in wanted], F.lit(0)) == 1
    hits = base.select("key", "length", F.explode(F.filter("terms", begins)).alias("term")).groupBy("key", "length", "term").agg(F.count("*").alias("tf"))
    seen = hits.groupBy("term").agg(F.count("*").alias("df"))  # terms that begin with a word of the query
    part = weight(total.n_texts, float(total.mean or 1.0) or 1.0)
    return hits.join(seen, "term").groupBy("key").agg(X.rounded(F.sum(part), 6).alias("score"))


def entities(g: Graph, query: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """(uid, kind, name, score): full-text hits, and names that hold the query with score 0, aliases resolved to their
    companies, the best ``limit``; a filter on kinds comes after the limit."""
    found = bm25(g.entities, "uid", "name", query).withColumnRenamed("key", "uid")
    like = g.entities.filter(F.col("canonical_name").contains(" ".join(query.lower().split()))).select("uid", F.lit(0.0).alias("score"))
    out = found.unionByName(like).join(alias_map(g), "uid", "left").groupBy(F.coalesce("canonical_uid", "uid").alias("uid")).agg(F.max("score").alias("score"))
    out = out.join(g.entities.select("uid", "kind", "name"), "uid").orderBy(F.desc("score"), "uid").limit(limit)
    return out.filter(F.col("kind").isin(*kinds)) if kinds else out


def by_glob(g: Graph, pattern: str, kind: str | None = None) -> DataFrame:
    """Entities whose name fits a case-sensitive shell pattern."""
    return (g.entities if kind is None else g.nodes(kind)).filter(F.col("name").rlike(X.glob_regex(pattern)))


def find_companies(g: Graph, name: str, limit: int = 20) -> DataFrame:
    """Companies found by name, alias or text."""
    return entities(g, name, ["company", "company_alias"], 5 * limit).filter(F.col("kind") == "company").limit(limit)
