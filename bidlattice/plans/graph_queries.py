"""Registered queries on the graph itself, on texts and on events, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import search, store, traverse
from ..sources import star
from ..streaming import incremental
from .oracles import sql

START = "CMP-00000001"


def _find_path(g) -> DataFrame:
    """A shortest path from one company to every other company and every buyer."""
    goals = g.entities.filter(X.is_kind("uid", "company", "organization")).select(F.lit(START).alias("start"), F.col("uid").alias("goal"))
    return traverse.paths(g, goals, 4).select("start", "goal", "hops")


def _levels(g) -> DataFrame:
    seeds = g.nodes("company").filter(F.col("uid") == START).select("uid")
    return traverse.hops(g, seeds, 4).select("seed", "uid", F.col("hops").cast("long").alias("hops"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 over whole documents, all that match."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return search.bm25(docs, "doc_id", "text", "idiot worthless").withColumnRenamed("key", "doc_id")


def _reload(spark: SparkSession, folder: str) -> DataFrame:
    """Companies, buyers and their tenders imported into an empty store by natural keys, twice: counts by kind and uids in use."""
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("supplier", "customer")}
    none = F.create_map().cast("map<string,string>")
    rows = lambda df, key, name, kind: df.select(F.col(key).alias("seq"), F.lit(kind).alias("kind"), F.col(name).alias("name"), none.alias("attributes"), F.lit("reload").alias("source"), F.lit(1.0).alias("confidence"))
    delta = rows(t["supplier"], "s_suppkey", "s_name", "company").unionByName(rows(t["customer"], "c_custkey", "c_name", "organization"))
    e = store.merge_entities(store.empty(spark).entities, delta, "2001-01-01")
    e = store.merge_entities(e, delta, "2001-01-02")
    return e.select("uid", "kind", "name")


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of events by type."""
    return incremental.event_counts(spark.read.parquet(f"{folder}/events.parquet")).withColumn("total", X.rounded("total", 2)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Users' sessions: events without a gap of half an hour."""
    s = incremental.sessions(spark.read.parquet(f"{folder}/events.parquet"))
    return s.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")], "events")


GRAPH = {
    "graph_statistics": store.statistics,
    "entities_by_kind": lambda g: g.entities.select("uid", "kind", "name", "canonical_name"),
    "relations_by_kind": lambda g: g.relations.select("id", "source_uid", "target_uid", "kind"),
    "find_entities": lambda g: store.find(g, "organization", "customer#0000000", None).select("uid", "name"),
    "glob_entities": lambda g: search.by_glob(g, "*#0000000[0-4]?", "organization").select("uid", "name"),
    "find_by_attribute": lambda g: store.find_by_attribute(g, "category", "1-URGENT", "tender").select("uid"),
    "neighbor_counts": lambda g: traverse.neighbors(g).groupBy("uid", "direction", "relation").agg(F.count("*").alias("n")),
    "related_companies": traverse.related_companies,
    "find_path": _find_path,
    "bfs_levels": _levels,
    "search_entities": lambda g: search.entities(g, "urgent customer 000000012", limit=50).select("uid", "kind"),
    "duplicate_keys": store.duplicate_keys,
    "company_identity": lambda g: store.company_identity(g).select("uid", "name", F.size("aliases").alias("aliases"), F.size("external_ids").alias("external_ids")),
}
TABLES = {"search_documents": _documents, "import_twice": _reload, "event_windows": _incremental, "event_sessions": _sessions}

QUERIES = {name: (lambda q: lambda spark, folder: q(star.kept(spark, folder)))(query) for name, query in GRAPH.items()} | TABLES

_E = """ent as (
  select company as uid, 'company' as kind, name from home union all select buyer, 'organization', name from org union all select printf('TEN-%08d', o_orderkey + 1), 'tender', 'Tender ' || o_orderkey from orders
  union all select printf('CTY-%08d', n_nationkey + 1), 'city', n_name from nation union all select printf('PRV-%08d', r_regionkey + 1), 'province', r_name from region
  union all select distinct 'IND-' || lpad(regexp_extract(p_brand, '(\\d+)$', 1), 8, '0'), 'industry', p_brand from part)"""
_R = """edg as (
  select tender as s, buyer as t, 'issued_by' as kind from tb union all select company, tender, case when is_win then 'awarded_to' else 'submitted_bid' end from tp union all select company, industry, 'in_industry' from ci
  union all select company, city, 'in_city' from home union all select company, province, 'in_province' from home)"""
_ADJ = "adj as (select s as uid, t as other, 'out' as direction, kind from edg union all select t, s, 'in', kind from edg)"
_LEVELS = f"""lev(uid, hops) as (select '{START}', 0 union select other, hops + 1 from lev join adj using (uid) where hops < 4)"""


def _recursive(body: str, *more: str) -> str:
    return sql(body, *more).replace("with ", "with recursive ", 1)


ORACLES = {
    "graph_statistics": sql("select 'entity' as what, kind, count(*) as n from ent group by 2 union all select 'relation', kind, count(*) from edg group by 2", _E, _R),
    "entities_by_kind": sql("select uid, kind, name, lower(name) as canonical_name from ent", _E),
    "relations_by_kind": sql("select substr(sha256(s || ':' || kind || ':' || t), 1, 16) as id, s as source_uid, t as target_uid, kind from edg", _R),
    "find_entities": sql("select uid, name from ent where kind = 'organization' and lower(name) like '%customer#0000000%'", _E),
    "glob_entities": sql("select uid, name from ent where kind = 'organization' and name glob '*#0000000[0-4]?'", _E),
    "find_by_attribute": sql("select tender as uid from tf where category = '1-URGENT'"),
    "neighbor_counts": sql("select uid, direction, kind as relation, count(*) as n from adj group by 1, 2, 3", _R, _ADJ),
    "related_companies": sql(
        """select uid, other, links from (select *, row_number() over (partition by uid order by links desc, other) as k from (
        select a.s as uid, b.s as other, count(*) as links from edg a join edg b on a.t = b.t where a.s <> b.s and a.s like 'CMP-%' and b.s like 'CMP-%' group by 1, 2)) where k <= 20""", _R),
    "find_path": _recursive(f"select '{START}' as start, uid as goal, h::int as hops from (select uid from ent where kind in ('company', 'organization')) left join (select uid, min(hops) as h from lev group by 1) using (uid)", _E, _R, _ADJ, _LEVELS),
    "bfs_levels": _recursive(f"select '{START}' as seed, uid, min(hops)::bigint as hops from lev group by uid", _R, _ADJ, _LEVELS),
    "duplicate_keys": sql("select kind, lower(name) as canonical_name, count(*) as n from ent group by 1, 2 having count(*) > 1", _E),
    "company_identity": sql("select company as uid, name, 0 as aliases, 0 as external_ids from home"),
    "search_entities": sql(
        """select uid, kind from (select key as uid, any_value(kind) as kind, floor(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean))) * 1e6::double + 0.500001::double) / 1e6::double as score
        from eh join ed using (term), es group by 1) order by score desc, uid limit 50""", _E,
        "et as (select uid as key, kind, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from ent)", "es as (select count(*) as n, avg(len(w)) as mean from et)",
        "eh as (select key, kind, len(w) as length, term, count(*) as tf from (select key, kind, w, unnest(w) as term from et) where starts_with(term, 'urgent') or starts_with(term, 'customer') or starts_with(term, '000000012') group by all)",
        "ed as (select term, count(*) as df from eh group by 1)"),
    "search_documents": """
with t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents),
s as (select count(*) as n, avg(len(w)) as mean from t),
h as (select doc_id, len(w) as length, term, count(*) as tf from (select doc_id, w, unnest(w) as term from t) where starts_with(term, 'idiot') or starts_with(term, 'worthless') group by 1, 2, 3),
d as (select term, count(*) as df from h group by 1)
select doc_id, floor(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean))) * 1e6::double + 0.500001::double) / 1e6::double as score from h join d using (term), s group by 1""",
    "import_twice": "select printf('CMP-%08d', row_number() over (order by s_suppkey)) as uid, 'company' as kind, s_name as name from supplier union all select printf('ORG-%08d', row_number() over (order by c_custkey)), 'organization', c_name from customer",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as events, floor(sum(value) * 100 + 0.500001::double) / 100 as total from events group by 1, 2",
    "event_sessions": """
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as "end", count(*) as events from (
  select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (
    select *, case when lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute > ts then 0 else 1 end as fresh from events)) group by user_id, s""",
}
