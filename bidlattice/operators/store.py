"""The graph store: set-based upserts with deterministic deduplication, uids and history, versions on disk, and lookups.

A delta of entities has (seq, kind, name, attributes, source, confidence), one of relations (seq, source_kind,
source_name, kind, target_kind, target_name, attributes, source, confidence, valid_from, valid_to); ``seq`` is the order
of arrival. Loading a delta twice changes nothing but ``updated_at``."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans import schema
from ..session import stored
from .views import Graph

BROADCAST_ROWS = 1_000_000  # keys that a broadcast may hold
ENTITY_DELTA = "seq long, kind string, name string, attributes map<string,string>, source string, confidence double"
RELATION_DELTA = (
    "seq long, source_kind string, source_name string, kind string, target_kind string, target_name string, attributes map<string,string>, "
    "source string, confidence double, valid_from string, valid_to string"
)


class Merged(NamedTuple):
    """New tables, the history rows of what changed, rows that could not be used, and the uids of entities in the delta."""

    entities: DataFrame
    relations: DataFrame
    history: DataFrame
    rejected: DataFrame
    touched: DataFrame


def empty(spark: SparkSession, as_of: str = "1970-01-01") -> Graph:
    return Graph(spark.createDataFrame([], schema.ENTITY), spark.createDataFrame([], schema.RELATION), as_of)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``n`` = 0, 1, ... in a total order: ranges sorted apart, then each one's base from a prefix sum."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    sorted_ = stored(sorted_, "numbered")
    part = F.shiftright("_id", 33)
    sizes = sorted(sorted_.groupBy(part.alias("p")).count().collect())  # as many rows as partitions
    bases, total = {}, 0
    for r in sizes:
        bases[r.p], total = total, total + r["count"]
    if not bases:
        return sorted_.withColumn("n", F.col("_id")).drop("_id")
    base = F.element_at(F.create_map(*[F.lit(x) for p, b in bases.items() for x in (p, b)]), part)
    return sorted_.withColumn("n", base + F.col("_id") - F.shiftleft(part, 33)).drop("_id")


def _last(value: str, when: Column | None = None) -> Column:
    return F.max_by(value, F.when(when, F.col("seq")) if when is not None else F.col("seq"))


def merge_entities(current: DataFrame, delta: DataFrame, now: str) -> DataFrame:
    """``current`` after an upsert of ``delta``; see ``upserted``."""
    return upserted(current, delta, now)[0]


def upserted(current: DataFrame, delta: DataFrame, now: str, reserve: Callable[[str, int], int] | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``current`` after an upsert of ``delta``, and the uids (uid) of the delta's entities.

    A company with a ``scraper_id`` is found by it alone; all else by kind and canonical name, of several the smallest
    uid. Names and canonical names are overwritten, attributes merged with later values winning, the source kept where
    the new one is null, and the confidence is the larger. New keys get uids after the largest of their prefix, in the
    order of their first row; with ``reserve`` (kind, how many) they are numbered on from what it gives. With ``known``, a
    ``snapshot``, an entity that isn't there gets the uid that it has there, and new numbers come after those of the
    snapshot too. Rows of one delta with scraper ids are merged before those without."""
    uids = current.select("uid").limit(0)
    prefixes = F.create_map(*[F.lit(x) for k, p in schema.PREFIXES.items() for x in (k, p)])
    rows = delta.withColumn("canonical_name", X.canonical("name")).filter(F.col("kind").isin(*schema.PREFIXES) & (F.coalesce("canonical_name", F.lit("")) != ""))
    sid = F.when(F.col("kind") == "company", X.truthy(F.col("attributes")["scraper_id"]))
    rows = rows.withColumn("sid", sid)
    for by_id in (True, False):
        mine = rows.filter(F.col("sid").isNotNull() if by_id else F.col("sid").isNull()).withColumn("key", F.col("sid") if by_id else F.col("canonical_name"))
        if not mine.limit(1).count():
            continue
        there = current.withColumn("key", sid if by_id else F.col("canonical_name")).filter("key is not null").groupBy("kind", "key").agg(F.min("uid").alias("uid"))
        if known is not None:
            old = known.withColumn("key", F.col("scraper_id") if by_id else F.col("canonical_name")).filter("key is not null").groupBy("kind", "key").agg(F.min("uid").alias("uid"))
            there = there.withColumn("order", F.lit(0)).unionByName(old.withColumn("order", F.lit(1))).groupBy("kind", "key").agg(F.min_by("uid", "order").alias("uid"))
        merged = mine.groupBy("kind", "key").agg(
            _last("name").alias("name"), _last("canonical_name").alias("canonical_name"),
            _last("source", F.col("source").isNotNull()).alias("source"), F.max("confidence").alias("confidence"), F.min("seq").alias("first"),
        )
        # Values combine before the shuffle, attribute by attribute, so a name of very many rows is no row of its own size.
        values = mine.select("kind", "key", "seq", F.explode("attributes").alias("a", "v")).filter("v is not null").groupBy("kind", "key", "a").agg(_last("v").alias("v"))
        values = values.groupBy("kind", "key").agg(F.map_from_entries(F.collect_list(F.struct("a", "v"))).alias("attributes"))
        merged = merged.join(values, ["kind", "key"], "left")
        merged = stored(merged.join(there, ["kind", "key"], "left"), "merged")
        used = current.select("kind", "uid") if known is None else current.select("kind", "uid").unionByName(known.select("kind", "uid"))
        largest = used.groupBy("kind").agg(F.max(F.substring_index("uid", "-", -1).cast("long")).alias("largest"))
        fresh = numbered(merged.filter("uid is null").select("kind", "key", "first"), F.col("kind"), F.col("first"), F.col("key"))
        start = fresh.groupBy("kind").agg(F.min("n").alias("start"), F.count("*").alias("many"))
        if reserve is not None:
            own = [(r.kind, reserve(r.kind, r.many) - 1) for r in start.collect()]  # a row for each kind
            largest = current.sparkSession.createDataFrame(own, "kind string, largest long")
        fresh = fresh.join(start, "kind").join(largest, "kind", "left")
        number = F.coalesce("largest", F.lit(0)) + F.col("n") - F.col("start") + 1
        given = fresh.select("kind", "key", F.concat(F.element_at(prefixes, F.col("kind")), F.format_string("-%08d", number)).alias("new_uid"))
        merged = merged.join(given, ["kind", "key"], "left").withColumn("uid", F.coalesce("uid", "new_uid"))
        new = merged.select("uid", *[F.col(c).alias(f"d_{c}") for c in ("kind", "name", "canonical_name", "attributes", "source", "confidence")])
        none = F.create_map().cast("map<string,string>")
        out = current.join(new, "uid", "full_outer")
        touched = F.col("d_kind").isNotNull()
        attributes = F.map_zip_with(F.coalesce("attributes", none), F.coalesce("d_attributes", none), lambda k, old, fresh_: F.coalesce(fresh_, old))
        out = out.select(
            "uid", F.coalesce("kind", "d_kind").alias("kind"), F.coalesce("d_name", "name").alias("name"), F.coalesce("d_canonical_name", "canonical_name").alias("canonical_name"), attributes.alias("attributes"),
            F.coalesce("d_source", "source").alias("source"), F.greatest("confidence", "d_confidence").alias("confidence"), F.coalesce("created_at", F.lit(now)).alias("created_at"),
            F.when(touched, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        )
        current, uids = stored(out, "entities"), uids.unionByName(merged.select("uid"))
    return current, uids.distinct()


def _aliases(g: Graph) -> DataFrame:
    """(canonical_name, alias_uid, scraper_id, uid) of aliases that lead to a company."""
    names = g.nodes("company_alias").select("canonical_name", F.col("uid").alias("alias_uid"), X.truthy(F.col("attributes")["scraper_id"]).alias("scraper_id"))
    found = alias_map(g).filter(X.is_kind("canonical_uid", "company")).select(F.col("uid").alias("alias_uid"), F.col("canonical_uid").alias("uid"))
    return names.join(found, "alias_uid")


def without_aliases(g: Graph, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """An entity delta without the companies that are known aliases of another, in ``g`` or by the alias edges of
    ``relations``: they are that company, and no second one is made of them. A company of that very name, and one with a
    scraper id, is its own."""
    said = relations.filter("kind = 'alias_of' and source_kind = 'company_alias' and target_kind = 'company'").select(X.canonical("source_name").alias("canonical_name"))
    known = _aliases(g).select("canonical_name").unionByName(said).distinct().join(g.nodes("company").select("canonical_name").distinct(), "canonical_name", "left_anti")
    other = (F.col("kind") == "company") & X.truthy(F.col("attributes")["scraper_id"]).isNull()
    rows = entities.withColumn("canonical_name", F.when(other, X.canonical("name")))
    return rows.join(known, "canonical_name", "left_anti").select(entities.columns)


def resolved(g: Graph, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A relation delta with ``source_uid`` and ``target_uid``, and the rows of which an endpoint is unknown.

    An endpoint is found by kind and canonical name, of several entities the smallest uid; a company also by the name of
    an alias that leads to it, where no company has that name. Edges other than alias_of never end at an alias: they
    are its company's. With columns ``source_id`` or ``target_id``, a scraper id where it is not null finds the company
    that has it, or whose alias does."""
    aliases = stored(_aliases(g), "aliases")
    own = g.entities.groupBy("kind", "canonical_name").agg(F.min("uid").alias("uid")).withColumn("order", F.lit(0))
    by_alias = aliases.groupBy("canonical_name").agg(F.min("uid").alias("uid")).select(F.lit("company").alias("kind"), "canonical_name", "uid", F.lit(1).alias("order"))
    names = own.unionByName(by_alias).groupBy("kind", "canonical_name").agg(F.min_by("uid", "order").alias("uid"))
    ids = g.nodes("company").select(X.truthy(F.col("attributes")["scraper_id"]).alias("id"), "uid", F.lit(0).alias("order")).unionByName(aliases.select(F.col("scraper_id").alias("id"), "uid", F.lit(1).alias("order")))
    ids = ids.filter("id is not null").groupBy("id").agg(F.min(F.struct("order", "uid")).alias("x")).select("id", F.col("x.uid").alias("id_uid"))
    out = delta
    for end in ("source", "target"):
        if f"{end}_id" not in out.columns:
            out = out.withColumn(f"{end}_id", F.lit(None).cast("string"))
        mine = names.select(F.col("kind").alias(f"{end}_kind"), F.col("canonical_name").alias(f"_{end}"), F.col("uid").alias(f"{end}_uid"))
        out = out.withColumn(f"_{end}", F.when(F.col(f"{end}_id").isNull(), X.canonical(f"{end}_name"))).join(mine, [f"{end}_kind", f"_{end}"], "left")
        out = out.join(ids.withColumnRenamed("id", f"{end}_id"), f"{end}_id", "left").withColumn(f"{end}_uid", F.coalesce("id_uid", f"{end}_uid")).drop("id_uid")
        company = aliases.select(F.col("alias_uid").alias(f"{end}_uid"), F.col("uid").alias("_company"))
        out = out.join(company, f"{end}_uid", "left").withColumn(f"{end}_uid", F.when(F.col("kind") != "alias_of", F.coalesce("_company", f"{end}_uid")).otherwise(F.col(f"{end}_uid"))).drop("_company")
    ok = F.col("source_uid").isNotNull() & F.col("target_uid").isNotNull() & F.col("kind").isin(*schema.RELATION_KINDS)
    out = stored(out, "resolved")
    return out.filter(ok), out.filter(~ok).select(delta.columns)


def merge_relations(current: DataFrame, delta: DataFrame, now: str) -> DataFrame:
    """``current`` after an upsert of ``delta`` with uids: attributes and valid_from of the first write stay, confidence is the
    larger, the source the last known one, and valid_to the last one written, null included."""
    d = delta.withColumn("id", X.relation_id("source_uid", "kind", "target_uid")).groupBy("id").agg(
        *[F.first(c).alias(f"d_{c}") for c in ("source_uid", "target_uid", "kind")], F.max("confidence").alias("d_confidence"), _last("source", F.col("source").isNotNull()).alias("d_source"),
        F.min_by("attributes", "seq").alias("d_attributes"), F.min_by("valid_from", "seq").alias("d_valid_from"), F.max_by("valid_to", "seq").alias("d_valid_to"),
    )
    new, old = F.col("d_kind").isNotNull(), F.col("kind").isNotNull()
    pick = lambda c: F.when(old, F.col(c)).otherwise(F.col(f"d_{c}")).alias(c)
    return current.join(d, "id", "full_outer").select(
        "id", *[pick(c) for c in ("source_uid", "target_uid", "kind")], F.greatest("confidence", "d_confidence").alias("confidence"), F.coalesce("d_source", "source").alias("source"),
        pick("attributes"), pick("valid_from"), F.when(new, F.col("d_valid_to")).otherwise(F.col("valid_to")).alias("valid_to"), F.coalesce("created_at", F.lit(now)).alias("created_at"),
    )


REJECTED = "seq long, kind string, name string, what string"


def load(g: Graph, entities: DataFrame, relations: DataFrame, now: str, changed_by: str = "import", changes: int = 0, reserve: Callable[[str, int], int] | None = None) -> Merged:
    """The graph's tables after both deltas. Entities of unknown kind or without a name, and relations of unknown kind or
    endpoints, are rejected rows. Alias edges come first, so that names of aliases find their companies in the same load.
    History rows are numbered on from ``changes``, those of one load in the order of their uids."""
    e, touched = upserted(g.entities, without_aliases(g, entities, relations), now, reserve)
    touched = stored(touched, "touched")
    alias_of = F.coalesce(F.col("kind") == "alias_of", F.lit(False))
    r, lost = g.relations, relations.limit(0)
    there = {x.alias for x in relations.select(alias_of.alias("alias")).distinct().collect()}
    for first in (True, False):
        if first in there:
            usable, more = resolved(Graph(e, r, g.as_of), relations.filter(alias_of == F.lit(first)))
            r, lost = stored(merge_relations(r, usable, now), "relations"), lost.unionByName(more, allowMissingColumns=True)
    bad = entities.filter(~F.coalesce(F.col("kind").isin(*schema.PREFIXES), F.lit(False)) | (F.coalesce(X.canonical("name"), F.lit("")) == ""))
    rejected = bad.select("seq", "kind", "name", F.lit("entity").alias("what")).unionByName(lost.select("seq", "kind", F.concat_ws(" -> ", "source_name", "target_name").alias("name"), F.lit("relation").alias("what")))
    history = e.join(touched, "uid", "left_semi").select("uid", F.to_json(F.struct("kind", "name", "attributes", "source", "confidence")).alias("snapshot"), F.lit(changed_by).alias("changed_by"), F.lit(now).alias("changed_at"))
    history = numbered(history, F.col("uid")).select("uid", "snapshot", "changed_by", "changed_at", (F.col("n") + changes + 1).alias("seq"))
    return Merged(e, r, history, rejected, touched)


def counts(before: Graph, entities: DataFrame, relations: DataFrame, rejected: DataFrame) -> dict[str, int]:
    """Numbers of one load, from the rows that it writes: entities and relations created, entities updated, rows rejected."""
    there = F.col("there").isNotNull()
    e = entities.join(before.entities.select("uid", F.lit(1).alias("there")), "uid", "left").agg(F.count_if(~there).alias("new"), F.count_if(there).alias("old")).first()
    r = relations.join(before.relations.select("id"), "id", "left_anti").count()
    return {"entities_created": e.new, "entities_updated": e.old, "relations_created": r, "rejected": rejected.count()}


def _some(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``df``'s rows with one of ``keys``, which are stored and are broadcast while there are BROADCAST_ROWS at most."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, "left_semi")


def wanted(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, canonical_name) and (id) by which a delta finds what is there: names of its entities and endpoints, those of companies
    as aliases too, and their scraper ids."""
    own = [entities.select("kind", X.canonical("name").alias("canonical_name"), X.truthy(F.col("attributes")["scraper_id"]).alias("id"))]
    none = F.lit(None).cast("string")
    for end in ("source", "target"):
        own.append(relations.select(F.col(f"{end}_kind").alias("kind"), X.canonical(f"{end}_name").alias("canonical_name"), (F.col(f"{end}_id") if f"{end}_id" in relations.columns else none).alias("id")))
    both = own[0].unionByName(own[1]).unionByName(own[2])
    names = both.filter("canonical_name <> ''").select("kind", "canonical_name")
    names = names.unionByName(names.filter("kind = 'company'").withColumn("kind", F.lit("company_alias")))
    keys = names.distinct().withColumn("id", F.lit(None).cast("string")).unionByName(both.select("id").filter("id is not null").distinct(), allowMissingColumns=True)
    keys = stored(keys, "wanted")
    return keys.filter("id is null").drop("id"), keys.filter("id is not null").select("id")


def relevant(g: Graph, names: DataFrame, ids: DataFrame) -> Graph:
    """The part of ``g`` that a delta with these names and ids (``wanted``, stored) can meet: loading the delta into it changes what
    loading it into ``g`` does.

    That is the entities of those names or scraper ids; what their alias edges lead to; and the edges among all those."""
    sid = X.truthy(F.col("attributes")["scraper_id"])
    found = _some(g.entities, names, ["kind", "canonical_name"])
    if ids.limit(1).count():
        found = found.unionByName(_some(g.nodes("company", "company_alias").withColumn("id", sid), ids, ["id"]).drop("id")).dropDuplicates(["uid"])
    found = front = stored(found, "named")
    while front.filter("kind = 'company_alias'").limit(1).count():
        there = stored(_some(g.edges("alias_of"), stored(front.select(F.col("uid").alias("source_uid")), "aliases"), ["source_uid"]).select(F.col("target_uid").alias("uid")).distinct().join(found.select("uid"), "uid", "left_anti"), "reached")
        front = stored(_some(g.nodes("company", "company_alias"), there, ["uid"]), "reached")
        found = found.unionByName(front)
    ends = lambda end: found.select(F.col("uid").alias(end))
    edges = _some(_some(g.relations, ends("source_uid"), ["source_uid"]), ends("target_uid"), ["target_uid"])
    return Graph(found, stored(edges, "relevant"), g.as_of)


def company_by_id(g: Graph, company_id: str) -> DataFrame:
    """The company of a uid, or of a scraper id that it or an alias of it has."""
    if str(company_id).upper().startswith("CMP-"):
        return get(g, str(company_id).upper()).filter("kind = 'company'")
    has = X.truthy(F.col("attributes")["scraper_id"]) == str(company_id)
    uids = g.nodes("company").filter(has).select("uid", F.lit(0).alias("order")).unionByName(_aliases(g).filter(F.col("scraper_id") == str(company_id)).select("uid", F.lit(1).alias("order")))
    return g.nodes("company").join(uids.orderBy("order", "uid").limit(1).select("uid"), "uid", "left_semi")


def alias_map(g: Graph, most: int = 10) -> DataFrame:
    """(uid, canonical_uid): aliases to the entity at the end of their alias_of chain, by pointer jumping; cycles stop after ``most`` rounds."""
    m = g.edges("alias_of").groupBy(F.col("source_uid").alias("uid")).agg(F.min("target_uid").alias("canonical_uid"))
    for _ in range(most if g.edges("alias_of").limit(1).count() else 0):
        step = m.alias("a").join(m.alias("b"), F.col("a.canonical_uid") == F.col("b.uid"), "left")
        m = stored(step.select("a.uid", F.coalesce("b.canonical_uid", "a.canonical_uid").alias("canonical_uid"), F.col("b.uid").isNotNull().alias("moved")), "alias")
        if not m.filter("moved").limit(1).count():
            break
        m = m.drop("moved")
    return m.select("uid", "canonical_uid")


def get(g: Graph, *uids: str) -> DataFrame:
    return g.entities.filter(F.col("uid").isin(*uids))


def find(g: Graph, kind: str | None = None, name_like: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Entities of a kind whose canonical name holds the canonical text (``%`` and ``_`` are wildcards), by name and uid."""
    out = g.entities if kind is None else g.nodes(kind)
    if name_like:
        out = out.filter(F.col("canonical_name").like("%" + " ".join(name_like.lower().split()) + "%"))
    out = out.orderBy("name", "uid").offset(offset)
    return out if limit is None else out.limit(limit)


def find_by_attribute(g: Graph, key: str, value, kind: str | None = None) -> DataFrame:
    """Entities with an attribute equal to the value; numbers compare as numbers."""
    a = F.col("attributes")[key]
    same = (X.number(a) == float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else (a == str(value))
    return (g.entities if kind is None else g.nodes(kind)).filter(same)


def relations_between(g: Graph, source: str, target: str) -> DataFrame:
    return g.relations.filter((F.col("source_uid") == source) & (F.col("target_uid") == target))


def statistics(g: Graph) -> DataFrame:
    """(what, kind, n): counts of entities and relations by kind."""
    e = g.entities.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("entity").alias("what"), "kind", "n")
    return e.unionByName(g.relations.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "kind", "n"))


def attach_identifier(g: Graph, uid: str, key: str, value: str, now: str) -> DataFrame:
    """Entities with one attribute of a company set; found by uid, whatever other companies of its name there are."""
    hit = (F.col("uid") == uid) & (F.col("kind") == "company")
    one = F.create_map(F.lit(key), F.lit(value))
    merged = F.map_zip_with(F.coalesce("attributes", F.create_map().cast("map<string,string>")), one, lambda k, old, new: F.coalesce(new, old))
    return g.entities.withColumn("attributes", F.when(hit, merged).otherwise(F.col("attributes"))).withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at")))


def company_identity(g: Graph) -> DataFrame:
    """(uid, name, external_ids, attributes, aliases, merge_candidates) of each company."""
    keys = F.array(*[F.lit(k) for k in schema.EXTERNAL_ID_KEYS])
    aliases = g.edges("alias_of").join(g.names("company_alias").withColumnRenamed("uid", "source_uid"), "source_uid").groupBy(F.col("target_uid").alias("uid")).agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    same = g.edges("same_as").select(F.explode(F.array(F.struct(F.col("source_uid").alias("uid"), F.col("target_uid").alias("o")), F.struct(F.col("target_uid").alias("uid"), F.col("source_uid").alias("o")))).alias("x")).select("x.*")
    same = same.groupBy("uid").agg(F.array_sort(F.collect_set("o")).alias("merge_candidates"))
    out = g.nodes("company").join(aliases, "uid", "left").join(same, "uid", "left")
    none = F.array().cast("array<string>")
    return out.select("uid", "name", F.map_filter("attributes", lambda k, v: F.array_contains(keys, k)).alias("external_ids"), F.map_filter("attributes", lambda k, v: ~F.array_contains(keys, k)).alias("attributes"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("merge_candidates", none).alias("merge_candidates"))


def save(g: Graph, folder: str) -> None:
    """Writes both tables, partitioned by kind, so that a filter on kind reads no other files."""
    for name, df in (("entities", g.entities), ("relations", g.relations)):
        df.write.partitionBy("kind").mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, as_of: str, normalise: bool = False, kept: bool = False) -> Graph:
    return Graph(spark.read.schema(schema.ENTITY).parquet(f"{folder}/entities"), spark.read.schema(schema.RELATION).parquet(f"{folder}/relations"), as_of, normalise, kept)


def duplicate_keys(g: Graph) -> DataFrame:
    """(kind, canonical_name, n): names that several entities of a kind share."""
    return g.entities.groupBy("kind", "canonical_name").agg(F.count("*").alias("n")).filter("n > 1")


def alias_integrity(g: Graph) -> DataFrame:
    """(problem, uid): alias edges to other kinds, from other kinds, and aliases without an edge."""
    e = g.edges("alias_of")
    wrong = e.filter(~X.is_kind("target_uid", "company")).select(F.lit("bad_target").alias("problem"), F.col("source_uid").alias("uid"))
    source = e.filter(~X.is_kind("source_uid", "company_alias")).select(F.lit("bad_source").alias("problem"), F.col("source_uid").alias("uid"))
    lone = g.nodes("company_alias").join(e.select(F.col("source_uid").alias("uid")), "uid", "left_anti").select(F.lit("orphan").alias("problem"), "uid")
    return wrong.unionByName(source).unionByName(lone)


def snapshot(entities: DataFrame) -> DataFrame:
    """(kind, canonical_name, scraper_id, uid): what a re-import needs to give entities the uids they had. A company with a scraper
    id is known by it, all else by name."""
    return entities.select("kind", "canonical_name", F.when(F.col("kind") == "company", X.truthy(F.col("attributes")["scraper_id"])).alias("scraper_id"), "uid")


def reimported(known: DataFrame, delta: DataFrame, now: str, current: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A delta of entities loaded into an empty graph, or ``current``, under the uids of a snapshot; and the problems (problem, uid),
    none of which may be there before the result is used: entities of the snapshot that have another uid now, and uids
    that another entity had. Uids of entities that are gone are not given again."""
    known = stored(known, "snapshot")
    out, _ = upserted(empty(delta.sparkSession).entities if current is None else current, delta, now, known=known)
    out = stored(out, "reimported")
    now_ = snapshot(out)
    key = lambda df: df.select("kind", F.when(F.col("scraper_id").isNotNull(), F.concat(F.lit("id|"), "scraper_id")).otherwise(F.concat(F.lit("name|"), "canonical_name")).alias("key"), "uid")
    a, b = key(known).groupBy("kind", "key").agg(F.min("uid").alias("old")), key(now_).groupBy("kind", "key").agg(F.min("uid").alias("uid"))
    moved = a.join(b, ["kind", "key"]).filter("old <> uid").select(F.lit("uid changed").alias("problem"), F.col("old").alias("uid"))
    taken = key(known).withColumnRenamed("key", "before").join(key(now_).drop("kind"), "uid").join(a.select(F.col("key").alias("before"), "kind"), ["kind", "before"]).filter("key <> before and not startswith(key, 'id|') and not startswith(before, 'id|')")
    return out, moved.unionByName(taken.select(F.lit("uid of another").alias("problem"), "uid"))


def uid_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, canonical_name, before_uid, after_uid, change): missing, new or changed uids of two versions."""
    a, b = (x.groupBy("kind", "canonical_name").agg(F.min("uid").alias(n)) for x, n in ((before, "before_uid"), (after, "after_uid")))
    out = a.join(b, ["kind", "canonical_name"], "full_outer")
    change = F.when(F.col("after_uid").isNull(), "missing").when(F.col("before_uid").isNull(), "new").when(F.col("before_uid") != F.col("after_uid"), "changed")
    return out.withColumn("change", change).filter("change is not null")
