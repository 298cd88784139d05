"""Registered queries on loads, aliases, history, importers and the code graph, over tables made from the driver's, and their DuckDB SQL.

The projection of the star schema has no aliases, identifiers, permits or dated awards; the graphs here have them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import exprs as X
from ..operators import adjacency, company, matching, nested, relationship, store, text_index, traverse
from ..operators.views import Graph
from ..session import scratch, stored
from ..sources import code, files, star
from ..streaming import incremental
from .graph_queries import _ADJ, _E, _R, START
from .graph_queries import ORACLES as GRAPH_ORACLES
from .oracles import sql

DAY, NEXT = "2001-01-01", "2001-01-02"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _entities(df: DataFrame, seq, kind: str, name, attributes: dict | None = None) -> DataFrame:
    b = files.Build(df.sparkSession, "made")
    b.entity(df.withColumn("seq", seq), kind, name, attributes)
    return b.done().entities


def _relations(df: DataFrame, seq, source: tuple, kind: str, target: tuple, confidence: float = 1.0) -> DataFrame:
    b = files.Build(df.sparkSession, "made")
    b.relation(df.withColumn("seq", seq), source, kind, target)
    return b.done().relations.withColumn("confidence", F.lit(confidence))


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "supplier").join(F.broadcast(_table(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are of fixed number


def _edges_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Companies and their cities loaded twice, the edges with another confidence: edges as they are then."""
    s = _suppliers(spark, folder)
    e = _entities(s, F.col("s_suppkey"), "company", F.col("s_name")).unionByName(_entities(_table(spark, folder, "nation"), F.col("n_nationkey") + (1 << 40), "city", F.col("n_name")))
    ends = ("company", F.lower("s_name")), "in_city", ("city", F.concat(F.lit("  "), "n_name"))
    one = store.load(store.empty(spark), e, _relations(s, F.col("s_suppkey"), *ends, 0.5), DAY)
    two = store.load(Graph(one.entities, one.relations, DAY), e, _relations(s, F.col("s_suppkey"), *ends, 0.9).unionByName(_relations(s, F.col("s_suppkey"), *ends, 0.7)), NEXT)
    return two.relations.select("id", "source_uid", "target_uid", "kind", "confidence", "created_at")


_MADE: dict[tuple, tuple[str, object]] = {}


def _once(make):
    """``make`` (spark, folder), whose tables are stored, once for each session and folder, and again when a table has changed."""

    def made(spark: SparkSession, folder: str):
        key = (make.__name__, spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), folder)
        signs = star.signs(spark, folder, (*star.TABLES, "documents"))
        if key not in _MADE or _MADE[key][0] != signs:
            _MADE[key] = (signs, make(spark, folder))
        return _MADE[key][1]

    return made


@_once
def _versions(spark: SparkSession, folder: str) -> tuple[str, Graph]:
    """All companies, then every tenth again with its balance, as two versions of one stored graph."""
    s, target = _suppliers(spark, folder), scratch(spark, "versions")
    none = spark.createDataFrame([], store.RELATION_DELTA)
    balance = {"balance": F.col("s_acctbal")}
    for when, rows, values in ((DAY, s, None), (NEXT, s.filter("s_suppkey % 10 = 0"), balance)):
        incremental.append(spark, target, files.Delta(_entities(rows, F.col("s_suppkey"), "company", F.col("s_name"), values), none, none), when)
    return target, incremental.current(spark, target)


def _history(spark: SparkSession, folder: str) -> DataFrame:
    """The kept history of both versions."""
    h = incremental.history(spark, _versions(spark, folder)[0])
    return h.select("uid", F.get_json_object("snapshot", "$.name").alias("name"), F.get_json_object("snapshot", "$.attributes.balance").isNotNull().alias("balanced"), "changed_by", "changed_at", "seq")


def _current(spark: SparkSession, folder: str) -> DataFrame:
    """The entities of the last version."""
    g = _versions(spark, folder)[1]
    return g.entities.select("uid", "name", F.col("attributes")["balance"].cast("double").alias("balance"), "created_at", "updated_at")


@_once
def _with_aliases(spark: SparkSession, folder: str) -> Graph:
    """Companies with an identifier; every second has an alias, of which every second has an alias again; awards and
    a second delta of companies name companies by their aliases."""
    s = _suppliers(spark, folder)
    even, fourth = s.filter("s_suppkey % 2 = 0"), s.filter("s_suppkey % 4 = 0")
    holding, old = F.concat("s_name", F.lit(" Holdings")), F.concat("s_name", F.lit(" Old"))
    e = _entities(s, F.col("s_suppkey"), "company", F.col("s_name"), {"id_duns": F.col("s_suppkey"), "city": F.col("n_name")})
    e = e.unionByName(_entities(even, F.col("s_suppkey"), "company_alias", holding)).unionByName(_entities(fourth, F.col("s_suppkey") + (1 << 30), "company_alias", old))
    r = _relations(even, F.col("s_suppkey"), ("company_alias", holding), "alias_of", ("company", F.col("s_name")))
    r = r.unionByName(_relations(fourth, F.col("s_suppkey"), ("company_alias", old), "alias_of", ("company_alias", holding)))
    m = store.load(store.empty(spark), e, r, DAY)
    again = _entities(fourth, F.col("s_suppkey"), "company", F.upper(old)).unionByName(_entities(even, F.col("s_suppkey") + (1 << 30), "tender", F.concat(F.lit("Tender of "), "s_name")))
    won = _relations(even, F.col("s_suppkey"), ("company", F.when(F.expr("s_suppkey % 4 = 0"), old).otherwise(holding)), "awarded_to", ("tender", F.concat(F.lit("Tender of "), "s_name")))
    lost = _relations(s.filter("s_suppkey % 10 = 1"), F.col("s_suppkey"), ("company", old), "awarded_to", ("tender", F.lit("no such tender")))
    m = store.load(Graph(m.entities, m.relations, DAY), again, won.unionByName(lost), NEXT)
    return Graph(m.entities, m.relations, NEXT)


def _alias_identity(spark: SparkSession, folder: str) -> DataFrame:
    who = store.company_identity(_with_aliases(spark, folder))
    return who.select("uid", "name", F.array_join("aliases", ",").alias("aliases"), F.col("external_ids")["id_duns"].cast("long").alias("duns"), F.col("attributes")["city"].alias("city"))


def _relational_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Companies with aliases, tenders, permits and awards as relational tables."""
    s, c, o, p = (_table(spark, folder, t) for t in ("supplier", "customer", "orders", "part"))
    n = s.count()
    same = [(F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("display_name"), F.col("s_name").alias("name")]
    companies = s.select(*same, F.when(F.expr("s_suppkey % 3 = 0"), "").otherwise("canonical").alias("entity_role"), F.lit(None).cast("long").alias("canonical_company_id"))
    alias = s.filter("s_suppkey % 5 = 0").select((F.col("s_suppkey") + n + 1).alias("id"), F.concat("s_name", F.lit(" Permits")).alias("display_name"), F.lit("").alias("name"), F.lit("applicant_alias").alias("entity_role"), (F.col("s_suppkey") + 1).alias("canonical_company_id"))
    tenders = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("c_name").alias("organization"), F.col("o_totalprice").alias("estimated_value"))
    permits = p.select(F.col("p_partkey").alias("id"), F.when(F.expr("p_partkey % 2 = 0"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))).alias("external_id"), F.lit(" ").alias("address"), (F.col("p_partkey") % (2 * n) + 1).alias("company_id"))
    awards = p.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.lit("").alias("title"), F.concat(F.lit("A-"), F.col("p_partkey").cast("string")).alias("external_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % n).cast("string"), 9, "0"), F.when(F.expr("p_partkey % 8 = 0"), " PERMITS").otherwise("")).alias("winner_company"), F.col("p_retailprice").alias("award_value"), F.lit(None).cast("long").alias("company_id"))
    return {"companies": companies.unionByName(alias), "tenders": tenders, "permits": permits, "contract_awards": awards}


def _relational(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with aliases, tenders, permits, awards and buyers as relational tables, loaded together: all edges."""
    stages = files.relational(spark, _relational_tables(spark, folder))
    e = r = None
    for k, (_, d) in enumerate(stages):
        own = d.entities.withColumn("seq", F.col("seq") + F.lit(k << 50)), d.relations.withColumn("seq", F.col("seq") + F.lit(k << 50))
        e, r = own if e is None else (e.unionByName(own[0]), r.unionByName(own[1], allowMissingColumns=True))
    m = store.load(store.empty(spark), e, r, DAY)
    names = m.entities.select("uid", "name")
    ends = m.relations.select("kind", "source_uid", "target_uid").join(names.select(F.col("uid").alias("source_uid"), F.col("name").alias("source")), "source_uid").join(names.select(F.col("uid").alias("target_uid"), F.col("name").alias("target")), "target_uid")
    return ends.select("kind", "source", "target")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """The relational tables loaded stage by stage, tenders in two pages, and then once more, which adds nothing: all entities."""
    tables, target = _relational_tables(spark, folder), scratch(spark, "pages")
    size = tables["tenders"].count() // 2 + 1
    for _ in range(2):
        incremental.import_tables(spark, target, tables, DAY, size)
    g = incremental.current(spark, target)
    return g.entities.select("kind", "name")


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """Companies and buyers streamed into one graph, each from a folder and with a checkpoint of its own, in turn; old files
    go in between, and the last call reads its folder again with a new checkpoint: all entities."""
    at, none = scratch(spark, "sources"), spark.createDataFrame([], store.RELATION_DELTA)
    for table, key, kind, part, check in (("supplier", "s_suppkey", "company", 0, "a"), ("customer", "c_custkey", "organization", 0, "b"), ("supplier", "s_suppkey", "company", 1, "a"), ("customer", "c_custkey", "organization", 1, "new")):
        rows = _table(spark, folder, table).filter(F.col(key) % 2 == part).select(F.col(key).alias("key"), F.col(f"{key[0]}_name").alias("name"))
        rows.write.mode("append").parquet(f"{at}/{table}")
        delta = lambda batch, kind=kind: files.Delta(_entities(batch, F.col("key"), kind, F.col("name")), none, none)
        incremental.import_files(spark, f"{at}/{table}", "key long, name string", f"{at}/graph", f"{at}/check-{check}", delta, DAY)
        incremental.vacuum(spark, f"{at}/graph", 1)
    return incremental.current(spark, f"{at}/graph").entities.select("uid", "kind", "name")


def _reimport(spark: SparkSession, folder: str) -> DataFrame:
    """Companies loaded anew into an empty graph under the uids of an old one: in another order, some gone, some new."""
    s = _table(spark, folder, "supplier").withColumn("up", F.col("s_suppkey").cast("long"))
    old = store.merge_entities(store.empty(spark).entities, _entities(s.filter("s_suppkey % 5 <> 1"), F.col("up"), "company", F.col("s_name")), DAY)
    again = _entities(s.filter("s_suppkey % 7 <> 2"), -F.col("up"), "company", F.upper("s_name"))
    new, problems = store.reimported(store.snapshot(old), again, NEXT)
    if problems.limit(1).count():
        raise ValueError("uids have changed")
    return new.select("uid", "name", "created_at")


def _registers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers, a second register that has each under another form of its name, and customers: companies of all three."""
    s = _table(spark, folder, "supplier")
    variant = F.when(F.expr("s_suppkey % 3 = 0"), F.concat(F.upper("s_name"), F.lit(" Ltd."))).when(F.expr("s_suppkey % 3 = 1"), F.concat(F.lit("Somebody DBA: "), "s_name")).otherwise(F.replace("s_name", F.lit("Supplier"), F.lit("Suplier")))
    own = s.select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), F.lit("a").alias("register"))
    other = s.select((F.col("s_suppkey") + (1 << 40)).alias("id"), variant.alias("name"), F.lit("b").alias("register"))
    buyers = _table(spark, folder, "customer").select((F.col("c_custkey") + (1 << 41)).alias("id"), F.col("c_name").alias("name"), F.lit("c").alias("register"))
    m = matching.merged(own.unionByName(other).unionByName(buyers))
    return m.select("match", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("registers", ",").alias("registers"), "rows")


@_once
def _nested(spark: SparkSession, folder: str) -> str:
    """Orders as entities with nested attributes, of which the status is a column too."""
    c = _table(spark, folder, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("profile")).alias("buyer"))
    o = _table(spark, folder, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    attributes = F.to_json(F.struct("buyer", F.col("o_orderstatus").alias("status"), F.array("o_orderpriority", F.date_format("o_orderdate", "yyyy")).alias("tags"), F.col("o_totalprice").alias("value")))
    at = scratch(spark, "nested")
    nested.write(o.select("o_orderkey", attributes.alias("attributes")), at, {"status": "string", "value": "double"})
    return at


def _contained(spark: SparkSession, folder: str) -> DataFrame:
    """Urgent open orders of 1997 by buyers of one segment, asked for by containment, and what stands at paths of them."""
    found = nested.find(nested.read(spark, _nested(spark, folder)), {"status": "O", "tags": ["1997", "1-URGENT"], "buyer": {"profile": {"segment": "BUILDING"}}})
    v = F.col("attributes")
    return found.select("o_orderkey", nested.at(v, "buyer", "name", as_="string").alias("buyer"), nested.at(v, "buyer", "profile", "nation", as_="long").alias("nation"), nested.at(v, "value", as_="double").alias("value"))


@_once
def _index(spark: SparkSession, folder: str) -> str:
    """An index of all documents, of which a third was first there with another text, and a third came later."""
    docs, target = _table(spark, folder, "documents"), scratch(spark, "index")
    third = F.col("doc_id") % 3
    text_index.append(spark, target, docs.filter(third < 2).withColumn("text", F.when(third == 1, F.concat(F.lit("idiot of the with "), F.reverse("text"))).otherwise(F.col("text"))), "doc_id", "text")
    text_index.append(spark, target, docs.filter(third > 0), "doc_id", "text")
    return target


#: Alternatives, a phrase, a word, a phrase that must not be there.
ASKED = '"of the" with -"the and" or idiot'


@_once
def _adjacency(spark: SparkSession, folder: str) -> adjacency.Stored:
    return adjacency.write(star.kept(spark, folder), scratch(spark, "adjacency"))


def _stored_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    g = star.kept(spark, folder)
    seeds = g.nodes("company").filter("uid <= 'CMP-00000020'").select("uid")
    return adjacency.neighbors(g, _adjacency(spark, folder), seeds)


def _dated(spark: SparkSession, folder: str) -> Graph:
    """The star graph with dated awards, and parts as permits of companies."""
    g, n = star.kept(spark, folder), _table(spark, folder, "supplier").count()
    day = g.facts.select(F.col("tender").alias("target_uid"), F.col("date").alias("day"))
    won = g.edges("awarded_to").join(day, "target_uid").withColumn("valid_from", F.col("day")).select(g.relations.columns)
    p = _table(spark, folder, "part")
    uid = X.uid("PRM", F.col("p_partkey") + 1)
    permits = star._entity(p, "permit", uid, F.concat(F.lit("P-"), F.col("p_partkey").cast("string")), {"project_value": F.col("p_retailprice"), "issue_date": F.concat(F.lit("19"), F.lpad((F.col("p_partkey") % 7 + 90).cast("string"), 2, "0"), F.lit("-05-01"))})
    has = star._relation(p, "has_permit", X.uid("CMP", F.col("p_partkey") % n + 1), uid)
    return Graph(g.entities.unionByName(permits), won.unionByName(has), g.as_of)


def _working(spark: SparkSession, folder: str) -> Graph:
    """Companies that work with the next ones by key, in both directions written once."""
    s = _table(spark, folder, "supplier")
    link = lambda step: s.filter(F.col("s_suppkey") % step == 0).select(X.uid("CMP", F.col("s_suppkey") + 1).alias("a"), X.uid("CMP", F.col("s_suppkey") + step + 1).alias("b"))
    edges = link(1).unionByName(link(3)).join(s.select(X.uid("CMP", F.col("s_suppkey") + 1).alias("b")), "b")
    entities = star._entity(s, "company", X.uid("CMP", F.col("s_suppkey") + 1), F.col("s_name"), {})
    return Graph(entities, star._relation(edges, "works_with", F.col("a"), F.col("b")), star.AS_OF)


def _paths(g: Graph) -> DataFrame:
    """Shortest paths of two hops at most from one company to all others, with every edge and node on them."""
    goals = g.entities.filter(X.is_kind("uid", "company")).select(F.lit(START).alias("start"), F.col("uid").alias("goal"))
    return traverse.paths(g, goals, 2).select("goal", "hops", F.array_join("path", " ").alias("path"))


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers written as a CSV of companies and read by its header: counts by kind of what is loaded."""
    at = scratch(spark, "csv")
    _suppliers(spark, folder).select(F.col("s_name").alias("company_name"), F.col("n_name").alias("city"), F.lit("").alias("phone")).coalesce(1).write.option("header", True).csv(at)
    d = files.sniffed(spark, at)
    m = store.load(store.empty(spark), d.entities, d.relations, DAY)
    return store.statistics(Graph(m.entities, m.relations, DAY))


@_once
def _code(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The code graph of source files made from tables: a class for each nation, one that inherits from it for each of its
    suppliers, and a table definition for each part."""
    text = lambda template, *columns: F.format_string(template, *[F.col(c).cast("string") for c in columns])
    supplier = "from app.n%1$s import N%1$s\n\n\nclass S%2$s(N%1$s):\n    def save(self):\n        return check_%2$s(self)\n\n\ndef check_%2$s(x):\n    return x\n"
    made = _table(spark, folder, "supplier").select(text("src/app/s%s.py", "s_suppkey").alias("path"), text(supplier, "s_nationkey", "s_suppkey").alias("content"))
    made = made.unionByName(_table(spark, folder, "nation").select(text("src/app/n%s.py", "n_nationkey").alias("path"), text("class N%s:\n    pass\n", "n_nationkey").alias("content")))
    made = made.unionByName(_table(spark, folder, "part").select(text("db/p%s.sql", "p_partkey").alias("path"), text("create table p%1$s (id int, brand text);\nselect brand from p%1$s;\n", "p_partkey").alias("content")))
    return code.resolved(stored(code.parsed_files(made.select("path", F.encode("content", "UTF-8").alias("content"), F.md5("content").alias("hash"))), "parsed"))


def _code_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _code(spark, folder)[0].select("kind", "qualified_name", F.col("line_start").cast("long").alias("line_start"))


def _code_relations(spark: SparkSession, folder: str) -> DataFrame:
    e, r = _code(spark, folder)
    names = e.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source"))
    ends = e.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("name"))
    return r.join(names, "source_id").join(ends, "target_id", "left").select("source", "kind", F.coalesce("name", "target_id").alias("target"))


def _percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles and bands of how well companies are documented."""
    scores = stored(api.confidence_scores(_with_aliases(spark, folder)), "scores")
    p = api.percentiles(scores)
    bands = api.score_histogram(scores).select(F.concat(F.lit("band"), F.col("band").cast("string")).alias("what"), F.col("n").cast("double").alias("value"))
    return p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), X.rounded(c, 6).alias("value")) for c in ("p50", "p90", "p95", "p99")])).alias("x")).select("x.*").unionByName(bands)


QUERIES = {
    "import_edges_twice": _edges_twice,
    "import_versions": _current,
    "entity_history": _history,
    "alias_map": lambda spark, folder: store.alias_map(_with_aliases(spark, folder)),
    "alias_awards": lambda spark, folder: _with_aliases(spark, folder).edges("awarded_to").select("source_uid", "target_uid"),
    "alias_identity": _alias_identity,
    "confidence_percentiles": _percentiles,
    "relational_import": _relational,
    "csv_import": _csv,
    "dated_yearly_stats": lambda spark, folder: company.yearly_stats(_dated(spark, folder)),
    "subcontractor_chains": lambda spark, folder: relationship.subcontractor_chains(_working(spark, folder), 2, 10).select("uid", F.array_join("chain", ",").alias("chain")),
    "path_hops": lambda spark, folder: _paths(star.kept(spark, folder)),
    "import_sources": _sources,
    "relational_pages": _pages,
    "reimport_uids": _reimport,
    "nested_attributes": _contained,
    "registers_matched": _registers,
    "index_search": lambda spark, folder: text_index.bm25(spark, _index(spark, folder), "idiot worthless", 50).withColumnRenamed("key", "doc_id"),
    "index_match": lambda spark, folder: text_index.match(spark, _index(spark, folder), ASKED).withColumnRenamed("key", "doc_id"),
    "stored_neighbors": _stored_neighbors,
    "stored_two_hops": lambda spark, folder: adjacency.two_hops(_adjacency(spark, folder), star.kept(spark, folder).nodes("company").select("uid")),
    "code_entities": _code_entities,
    "code_relations": _code_relations,
}

_S = "s as (select *, printf('CMP-%08d', row_number() over (order by s_suppkey)) as uid from supplier join nation on n_nationkey = s_nationkey)"
_N = "n as (select n_nationkey, printf('CTY-%08d', row_number() over (order by n_nationkey)) as city from nation)"
_AL = """al as (select printf('ALI-%08d', row_number() over (order by o, s_suppkey)) as alias, uid, s_suppkey, o from (
  select s_suppkey, uid, 0 as o from s where s_suppkey % 2 = 0 union all select s_suppkey, uid, 1 from s where s_suppkey % 4 = 0))"""
_ID = "(select s_suppkey, row_number() over (order by s_suppkey) as k from supplier where s_suppkey % 2 = 0)"


ORACLES = {
    "import_edges_twice": f"with {_S}, {_N} select substr(sha256(uid || ':in_city:' || city), 1, 16) as id, uid as source_uid, city as target_uid, 'in_city' as kind, 0.9::double as confidence, '{DAY}' as created_at from s join n using (n_nationkey)",
    "import_versions": f"with {_S} select uid, s_name as name, case when s_suppkey % 10 = 0 then s_acctbal end as balance, '{DAY}' as created_at, case when s_suppkey % 10 = 0 then '{NEXT}' else '{DAY}' end as updated_at from s",
    "entity_history": f"""with {_S}, h as (select uid, s_name as name, false as balanced, '{DAY}' as changed_at from s union all select uid, s_name, true, '{NEXT}' from s where s_suppkey % 10 = 0)
        select uid, name, balanced, 'import' as changed_by, changed_at, row_number() over (order by changed_at, uid) as seq from h""",
    "alias_map": f"with {_S}, {_AL} select alias as uid, uid as canonical_uid from al",
    "alias_awards": f"with {_S} select uid as source_uid, printf('TEN-%08d', k) as target_uid from s join {_ID} using (s_suppkey)",
    "alias_identity": f"with {_S} select uid, s_name as name, case when s_suppkey % 2 = 0 then s_name || ' Holdings' else '' end as aliases, s_suppkey as duns, n_name as city from s",
    "confidence_percentiles": f"""with {_S}, sc as (select floor((1 / 3::double * 0.3::double + case when s_suppkey % 2 = 0 then 0.5::double * 0.25::double + 0.2::double * 0.2::double else 0 end + 0.15::double) * 1e4 + 0.500001::double) / 1e4 as score from s),
        p as (select quantile_cont(score, [0.5, 0.9, 0.95, 0.99]) as q from sc)
        select unnest(['p50', 'p90', 'p95', 'p99']) as what, unnest([floor(x * 1e6::double + 0.500001::double) / 1e6::double for x in q]) as value from p
        union all select 'band' || least(floor(score * 10), 9)::int, count(*)::double from sc group by 1""",
    "relational_import": """with n as (select count(*) as n from supplier), c as (select s_suppkey as id, s_name as company from supplier union all select s_suppkey + n, s_name from supplier, n where s_suppkey % 5 = 0)
        select 'alias_of' as kind, s_name || ' Permits' as source, s_name as target from supplier where s_suppkey % 5 = 0
        union all select 'has_permit', company, case when p_partkey % 2 = 0 then 'P-' || p_partkey else 'permit-' || p_partkey end from part, n, c where c.id = p_partkey % (2 * n)
        union all select 'awarded_to', 'A-' || p_partkey, s_name from part, n join supplier on s_suppkey = p_partkey % n where p_partkey % 4 = 0 and (p_partkey % 8 <> 0 or s_suppkey % 5 = 0)""",
    "import_sources": """select printf('CMP-%08d', row_number() over (order by s_suppkey % 2, s_suppkey)) as uid, 'company' as kind, s_name as name from supplier
        union all select printf('ORG-%08d', row_number() over (order by c_custkey % 2, c_custkey)), 'organization', c_name from customer""",
    "relational_pages": """select 'company' as kind, s_name as name from supplier union all select 'company_alias', s_name || ' Permits' from supplier where s_suppkey % 5 = 0
        union all select 'tender', 'Order ' || o_orderkey from orders union all select 'organization', c_name from customer semi join orders on o_custkey = c_custkey
        union all select 'permit', case when p_partkey % 2 = 0 then 'P-' || p_partkey else 'permit-' || p_partkey end from part union all select 'contract', 'A-' || p_partkey from part where p_partkey % 4 = 0""",
    "reimport_uids": f"""with o as (select s_suppkey, row_number() over (order by s_suppkey) as n from supplier where s_suppkey % 5 <> 1),
        f as (select s_suppkey, (select count(*) from o) + row_number() over (order by s_suppkey desc) as n from supplier where s_suppkey % 5 = 1 and s_suppkey % 7 <> 2)
        select printf('CMP-%08d', n) as uid, upper(s_name) as name, '{NEXT}' as created_at from supplier join (from o union all from f) using (s_suppkey) where s_suppkey % 7 <> 2""",
    "nested_attributes": """select o_orderkey, c_name as buyer, c_nationkey::bigint as nation, o_totalprice as value from orders join customer on c_custkey = o_custkey
        where o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and year(o_orderdate) = 1997 and c_mktsegment = 'BUILDING'""",
    "registers_matched": f"""select s_suppkey::bigint as match, s_name as name, case s_suppkey % 3 when 0 then upper(s_name) || ' Ltd.' when 1 then 'Somebody DBA: ' || s_name else replace(s_name, 'Supplier', 'Suplier') end as aliases, 'a,b' as registers, 2::bigint as rows from supplier
        union all select c_custkey + {1 << 41}, c_name, '', 'c', 1 from customer""",
    "index_search": GRAPH_ORACLES["search_documents"] + " order by score desc, doc_id limit 50",
    "index_match": r"""with t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
        tok as (select doc_id, unnest(w) as term, unnest(range(len(w))) as p from t), two as (select *, lead(term) over (partition by doc_id order by p) as nxt from tok),
        a as (select doc_id, p as s, p + 1 as e from two where term = 'of' and nxt = 'the'), b as (select doc_id, p as s, p as e from tok where term = 'with'), c as (select doc_id, p as s, p as e from tok where term = 'idiot'),
        n as (select distinct doc_id from two where term = 'the' and nxt = 'and'),
        cand as (select a.doc_id, least(a.s, b.s) as s, greatest(a.e, b.e) as e from a join b using (doc_id) where a.doc_id not in (select doc_id from n) union all from c),
        best as (select doc_id, e, max(s) as s from cand group by 1, 2),
        cov as (select * from (select *, max(s) over (partition by doc_id order by e rows between unbounded preceding and 1 preceding) as m from best) where m is null or s > m),
        sp as (select cov.doc_id, s, e, count(*) as k from cov join tok on tok.doc_id = cov.doc_id and p between s and e and term in ('of', 'the', 'with', 'idiot') group by 1, 2, 3)
        select doc_id, floor(sum(0.1::double / (2 + e - s - k)) * 1e6::double + 0.500001::double) / 1e6::double as rank from sp group by 1""".replace("\\", "\\"),
    "stored_neighbors": sql("select adj.uid, direction, adj.kind as relation, other, ent.kind as other_kind, name as other_name from adj join ent on ent.uid = other where adj.uid between 'CMP-00000001' and 'CMP-00000020'", _E, _R, _ADJ),
    "stored_two_hops": sql("select x.uid, count(*) as walks, count(distinct y.other) as ends from adj x join adj y on y.uid = x.other where x.uid like 'CMP-%' group by 1", _R, _ADJ),
    "csv_import": "select 'entity' as what, 'company' as kind, count(*) as n from supplier union all select 'entity', 'city', count(distinct s_nationkey) from supplier union all select 'relation', 'in_city', count(*) from supplier",
    "dated_yearly_stats": sql(
        """select uid, y as year, count(*) filter (k = 'c') as contract_count, coalesce(round(sum(v) filter (k = 'c'), 2), 0.0) as contract_value, count(*) filter (k = 'p') as permit_count, coalesce(round(sum(v) filter (k = 'p'), 2), 0.0) as permit_value from (
        select company as uid, y::varchar as y, 'c' as k, cv as v from tp join tf using (tender) where is_win
        union all select printf('CMP-%08d', p_partkey % n + 1), (1990 + p_partkey % 7)::varchar, 'p', p_retailprice from part, (select count(*) as n from supplier)) group by 1, 2"""),
    "subcontractor_chains": """with e as (select s_suppkey as a, s_suppkey + 1 as b from supplier union select s_suppkey, s_suppkey + 3 from supplier where s_suppkey % 3 = 0), k as (select a, b from e where b in (select s_suppkey from supplier)),
        j as (select a, b from k union select b, a from k), ch as (select x.a, printf('CMP-%08d', x.b + 1) || ',' || printf('CMP-%08d', y.b + 1) as chain from j x join j y on y.a = x.b where y.b <> x.a)
        select printf('CMP-%08d', a + 1) as uid, chain from (select *, row_number() over (partition by a order by chain) as r from ch) where r <= 10""",
    "path_hops": sql(
        f"""select goal, hops, path from (select goal, hops, array_to_string(arg_min(path, path), ' ') as path from (select goal, hops, path, min(hops) over (partition by goal) as h from (
        select '{START}' as goal, 0 as hops, ['{START}'] as path union all select other, 1, ['{START}', rel, other] from a1 where uid = '{START}'
        union all select y.other, 2, ['{START}', x.rel, x.other, y.rel, y.other] from a1 x join a1 y on y.uid = x.other where x.uid = '{START}')) where hops = h group by 1, 2) where goal like 'CMP-%'
        union all select company, null, null from home where company <> '{START}' and company not in (select y.other from a1 x join a1 y on y.uid = x.other where x.uid = '{START}') and company not in (select other from a1 where uid = '{START}')""",
        _R, _ADJ, "a1 as (select uid, other, min(kind) as rel from adj group by 1, 2)"),
    "code_entities": """with x as (select 'app.s' || s_suppkey as m, 'S' || s_suppkey as c, 'check_' || s_suppkey as f from supplier), p as (select 'p' || p_partkey as t from part), n as (select 'app.n' || n_nationkey as m, 'N' || n_nationkey as c from nation)
        select 'module' as kind, m as qualified_name, 1::bigint as line_start from x union all select 'class', m || '.' || c, 4 from x union all select 'method', m || '.' || c || '.save', 5 from x union all select 'function', m || '.' || f, 9 from x
        union all select 'module', m, 1 from n union all select 'class', m || '.' || c, 1 from n union all select 'module', 'db.' || t, 1 from p union all select 'sql_table', t, 1 from p union all select 'sql_column', t || unnest(['.id', '.brand']), 1 from p""",
    "code_relations": """with x as (select 'app.s' || s_suppkey as m, 'app.s' || s_suppkey || '.S' || s_suppkey as c, 'app.s' || s_suppkey || '.check_' || s_suppkey as f, 'app.n' || s_nationkey as n, 'app.n' || s_nationkey || '.N' || s_nationkey as b from supplier), p as (select 'p' || p_partkey as t from part)
        select m as source, 'imports' as kind, n as target from x union all select m, 'imports_name', b from x union all select m, 'defines', c from x union all select c, 'inherits', b from x union all select c, 'contains', c || '.save' from x
        union all select c || '.save', 'calls', f from x union all select m, 'defines', f from x union all select 'app.n' || n_nationkey, 'defines', 'app.n' || n_nationkey || '.N' || n_nationkey from nation
        union all select 'db.' || t, 'defines', t from p union all select t, 'contains', t || unnest(['.id', '.brand']) from p union all select 'db.' || t, 'uses_table', t from p""",
}
