"""Neighbours, hops and paths by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import stored
from .competitive import _top
from .pairs import Kind, counted
from .views import Graph


def neighbors(g: Graph, seeds: DataFrame | None = None, direction: str = "both", kinds: list[str] | None = None, active_only: bool = False, limit: int | None = None) -> DataFrame:
    """(uid, direction, relation, other, other_kind, other_name): one-hop neighbours of all entities, or of ``seeds`` (uid).

    ``active_only``: edges without an end of validity. ``limit``: per entity and direction, by uid."""
    a = g.adjacency
    if direction != "both":
        a = a.filter(F.col("direction") == direction)
    if kinds:
        a = a.filter(F.col("relation").isin(*kinds))
    if active_only:
        a = a.filter("valid_to is null")
    if seeds is not None:
        a = a.join(seeds.select("uid").distinct(), "uid", "left_semi")
    other = g.entities.select(F.col("uid").alias("other"), F.col("kind").alias("other_kind"), F.col("name").alias("other_name"))
    out = a.join(other, "other").select("uid", "direction", "relation", "other", "other_kind", "other_name")
    if limit is not None:
        out = _top(out.withColumn("_k", F.concat_ws("|", "uid", "direction")), "_k", ["other", "relation"], limit).drop("_k")
    return out


def grouped(g: Graph, seeds: DataFrame | None = None) -> DataFrame:
    """(uid, total, relations): number of neighbours by relation kind, as a map."""
    n = neighbors(g, seeds).groupBy("uid", "relation").agg(F.count("*").alias("n"))
    return n.groupBy("uid").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("relations"))


def hops(g: Graph, seeds: DataFrame, max_depth: int = 6, kinds: list[str] | None = None) -> DataFrame:
    """(seed, uid, hops): everything within ``max_depth`` undirected hops of each seed (uid), itself with 0.

    A round joins the last frontier with the edges and drops what is known; it stops when nothing new is found."""
    a = g.adjacency if not kinds else g.adjacency.filter(F.col("relation").isin(*kinds))
    a = stored(a.select("uid", "other").distinct(), "adjacency")
    front = seeds.select(F.col("uid").alias("seed"), "uid").distinct().withColumn("hops", F.lit(0))
    seen = front = stored(front, "front")
    for depth in range(1, max_depth + 1):
        near = front.join(a, "uid").select("seed", F.col("other").alias("uid")).distinct()
        front = stored(near.join(seen, ["seed", "uid"], "left_anti").withColumn("hops", F.lit(depth)), "front")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def paths(g: Graph, pairs: DataFrame, max_depth: int = 6, kinds: list[str] | None = None) -> DataFrame:
    """(start, goal, hops, path): a shortest undirected path of each pair, the smallest of equals; 0 hops from a node to itself.

    Pairs without a path of at most ``max_depth`` hops have null hops."""
    a = g.adjacency if not kinds else g.adjacency.filter(F.col("relation").isin(*kinds))
    a = stored(a.groupBy("uid", "other").agg(F.min("relation").alias("relation")), "adjacency")
    pairs = stored(pairs.select("start", "goal").distinct(), "pairs")
    front = seen = stored(pairs.select("start", F.col("start").alias("uid"), F.array("start").alias("path")).distinct(), "front")
    done = pairs.filter("start = goal").select("start", "goal", F.lit(0).alias("hops"), F.array("start").alias("path"))
    open_ = pairs.filter("start <> goal")
    for depth in range(1, max_depth + 1):
        near = front.join(a, "uid").select("start", F.col("other").alias("uid"), F.concat("path", F.array("relation", "other")).alias("path")).groupBy("start", "uid").agg(F.min("path").alias("path"))
        front = stored(near.join(seen.select("start", "uid"), ["start", "uid"], "left_anti"), "front")
        hit = front.withColumnRenamed("uid", "goal").join(open_, ["start", "goal"]).select("start", "goal", F.lit(depth).alias("hops"), "path")
        done = stored(done.unionByName(hit), "paths")
        open_ = open_.join(done.select("start", "goal"), ["start", "goal"], "left_anti")
        if not open_.limit(1).count() or not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return pairs.join(done, ["start", "goal"], "left")


def related_companies(g: Graph, seeds: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """(uid, other, links): companies one hop away, or two hops through anything but a company."""
    e = g.relations.select("source_uid", "target_uid")
    out = e.select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("other")).unionByName(e.select(F.col("target_uid").alias("uid"), F.col("source_uid").alias("other"))).filter(X.is_kind("uid", "company") & F.col("other").isNotNull())
    # Companies share a node that is none, and an edge between two of them is a key that only they have.
    via = F.when(X.is_kind("other", "company"), F.concat_ws(":", F.least("uid", "other"), F.greatest("uid", "other"))).otherwise(F.col("other"))
    mine = out if seeds is None else out.join(seeds.select("uid").distinct(), "uid", "left_semi")
    members = lambda df: df.select("uid", via.alias("via"))
    found = counted({"links": Kind(members(mine), None if seeds is None else members(out))}, most=None if limit is None else ({"links": 1}, limit)).named("uid", "other")
    loops = mine.filter("uid = other").select("uid").distinct().select("uid", F.col("uid").alias("other"), F.lit(1).cast("long").alias("links"))
    return _top(found.unionByName(loops), "uid", [F.desc("links"), "other"], limit)
