"""Importers: CSV by a declared schema, CSV by its header, JSON, a folder of known files, and relational tables.

Each returns a ``Delta`` of entities and relations by natural keys, which ``operators.store.load`` resolves and merges;
nothing is looked up row by row. Rows without a name are left out and counted in ``skipped``."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.store import ENTITY_DELTA, RELATION_DELTA, numbered

#: Texts that mean nothing.
EMPTY = ("", "nan", "none", "n/a", "-")
#: Provinces and their short forms; ``canada`` counts as one.
PROVINCES = {
    "bc": "British Columbia", "ab": "Alberta", "sk": "Saskatchewan", "mb": "Manitoba", "on": "Ontario", "qc": "Quebec", "nb": "New Brunswick",
    "ns": "Nova Scotia", "pe": "Prince Edward Island", "nl": "Newfoundland and Labrador", "yt": "Yukon", "nt": "Northwest Territories", "nu": "Nunavut",
}


class Delta(NamedTuple):
    entities: DataFrame
    relations: DataFrame
    skipped: DataFrame


def clean(x) -> Column:
    """Trimmed text, null where it means nothing."""
    t = F.regexp_replace(X._c(x).cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(~F.lower(t).isin(*EMPTY), t)


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with the order of its rows in its files. Tables without such an order are numbered by their key instead."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def _read(spark: SparkSession, path: str, limit: int | None = None, lines: bool = True) -> DataFrame:
    """A CSV with a header; a byte order mark is no part of the first name, and quotes may hold line ends. Without that
    (``lines`` false) a large file is read in splits; with ``limit``, the first rows in the order of the file."""
    df = spark.read.option("header", True).option("multiLine", lines).option("escape", '"').csv(path)
    df = _numbered(df.toDF(*[c.lstrip("﻿").strip() for c in df.columns]))
    return df if limit is None else df.orderBy("seq").limit(limit)


def _map(pairs: dict[str, Column]) -> Column:
    """A map of those values that are not null."""
    if not pairs:
        return F.create_map().cast("map<string,string>")
    both = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(both, lambda k, v: v.isNotNull())


class Build:
    """Collects projections of one DataFrame into a delta. ``seq`` grows with the row and then the projection."""

    def __init__(self, spark: SparkSession, source: str):
        self.spark, self.source, self.e, self.r, self.lost, self.step = spark, source, [], [], [], 0

    def _seq(self) -> Column:
        self.step += 1
        return (F.col("seq") * 64 + self.step).alias("seq")

    def entity(self, df: DataFrame, kind, name: Column, attributes: dict | Column | None = None, when: Column | None = None, report: bool = False) -> None:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        values = attributes if isinstance(attributes, Column) else _map(attributes or {})
        rows = df if when is None else df.filter(when)
        named = rows.select(self._seq(), kind.alias("kind"), clean(name).alias("name"), values.alias("attributes"), F.lit(self.source).alias("source"), F.lit(1.0).alias("confidence"))
        self.e.append(named.filter("name is not null"))
        if report:
            self.lost.append(named.filter("name is null").select("seq", F.lit("no name").alias("reason")))

    def relation(self, df: DataFrame, source: tuple, kind, target: tuple, attributes: dict | None = None, when: Column | None = None, valid_from: Column | None = None, more: dict | None = None) -> None:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        rows = df if when is None else df.filter(when)
        out = rows.select(
            self._seq(), lit(source[0]).alias("source_kind"), clean(source[1]).alias("source_name"), lit(kind).alias("kind"), lit(target[0]).alias("target_kind"), clean(target[1]).alias("target_name"),
            _map(attributes or {}).alias("attributes"), F.lit(self.source).alias("source"), F.lit(1.0).alias("confidence"), (F.lit(None).cast("string") if valid_from is None else valid_from).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
            *[v.alias(k) for k, v in (more or {}).items()],
        )
        self.r.append(out.filter("source_name is not null and target_name is not null"))

    def by_id(self, df: DataFrame, company_id: Column, kind: str, target: tuple, attributes: dict | None = None, valid_from: Column | None = None) -> None:
        """An edge from the company that has a scraper id, or whose alias has."""
        rows = df.withColumn("_id", company_id.cast("string")).filter("_id is not null")
        self.relation(rows, ("company", F.concat(F.lit("scraper id "), F.col("_id"))), kind, target, attributes, valid_from=valid_from, more={"source_id": F.col("_id")})

    def places(self, df: DataFrame, kind: str, name: Column, location: Column) -> None:
        """City and province edges of a text such as ``Victoria, BC``; parts are cut at commas, slashes and bars."""
        short = F.create_map(*[F.lit(x) for k, v in PROVINCES.items() for x in (k, v)])
        full = F.array(*[F.lit(v.lower()) for v in PROVINCES.values()], F.lit("canada"))
        part = df.withColumn("_n", name).withColumn("_p", F.explode(F.split(location, r"[,/|]"))).withColumn("_p", clean("_p")).filter("_p is not null")
        part = part.withColumn("_full", F.try_element_at(short, F.lower("_p"))).withColumn("_is", F.col("_full").isNotNull() | F.array_contains(full, F.lower("_p"))).withColumn("_p", F.coalesce("_full", "_p"))
        node, edge = F.when(F.col("_is"), "province").otherwise("city"), F.when(F.col("_is"), "in_province").otherwise("in_city")
        self.entity(part, node, F.col("_p"))
        self.relation(part, (kind, F.col("_n")), edge, (node, F.col("_p")))

    def done(self) -> Delta:
        union = lambda parts, schema: self.spark.createDataFrame([], schema) if not parts else parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1], allowMissingColumns=True), *parts[2:]], schema)
        return Delta(union(self.e, ENTITY_DELTA), union(self.r, RELATION_DELTA), union(self.lost, "seq long, reason string"))


def csv(spark: SparkSession, path: str, schema: dict, source: str = "csv") -> Delta:
    """Rows by ``schema``: kind, name (column), attributes (column to key), relations (list of column, kind, target_kind)."""
    df, b = _read(spark, path), Build(spark, source)
    name = F.col(schema["name"])
    b.entity(df, schema["kind"], name, {k: clean(c) for c, k in schema.get("attributes", {}).items() if c in df.columns}, report=True)
    for r in schema.get("relations", []):
        if r["column"] in df.columns:
            b.entity(df, r["target_kind"], F.col(r["column"]))
            b.relation(df, (schema["kind"], name), r["kind"], (r["target_kind"], F.col(r["column"])))
    return b.done()


def json(spark: SparkSession, path: str, source: str = "json") -> Delta:
    """An array of entities (kind, name, attrs), or an object with ``entities`` and ``relations``; kinds in any case."""
    text = spark.read.option("wholetext", True).text(path)
    attrs = "map<string,string>"
    entity = f"struct<kind:string,name:string,attrs:{attrs},attributes:{attrs}>"
    relation = "struct<source_kind:string,source_name:string,target_kind:string,target_name:string,kind:string>"
    whole = text.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    listed = F.from_json("value", f"array<{entity}>")
    boxed = F.from_json("value", f"struct<entities:array<{entity}>,relations:array<{relation}>>")
    is_list = F.ltrim("value").startswith("[")
    e = _numbered(whole.select(F.explode(F.when(is_list, listed).otherwise(boxed.entities)).alias("x")).select("x.*"))
    r = _numbered(whole.filter(~is_list).select(F.explode(boxed.relations).alias("x")).select("x.*"))
    b = Build(spark, source)
    b.entity(e, F.lower("kind"), F.col("name"), F.coalesce("attributes", "attrs", F.create_map().cast(attrs)), report=True)
    b.relation(r, (F.lower("source_kind"), F.col("source_name")), F.lower("kind"), (F.lower("target_kind"), F.col("target_name")))
    return b.done()


def _first(df: DataFrame, *names: str) -> Column:
    there = [clean(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def sniff(columns: list[str]) -> str:
    """The data set a header belongs to: permits, awards, tenders or companies, the first that fits."""
    c = {x.lower() for x in columns}
    if c & {"permit_number", "permit_no", "permit_type"}:
        return "permits"
    if c & {"vendor_name", "winner", "winner_company", "awarded_to"}:
        return "awards"
    if c & {"tender_title", "title", "closing_at", "closing_date"}:
        return "tenders"
    if c & {"company_name", "company", "business_name"}:
        return "companies"
    raise ValueError(f"no known data set has the columns {sorted(c)}")


def sniffed(spark: SparkSession, path: str, source: str = "sniffed", limit: int | None = None) -> Delta:
    """A CSV whose header tells what it holds. Awards are edges from company to tender, and back as awarded_by."""
    df = _read(spark, path, limit)
    return {"permits": _permits, "awards": _awards, "tenders": _tenders, "companies": _companies}[sniff(df.columns)](Build(spark, source), df)


def _tenders(b: Build, df: DataFrame) -> Delta:
    title = _first(df, "title", "tender_title", "name")
    organisation = _first(df, "organization", "company", "buyer")
    b.entity(df, "tender", title, {
        "estimated_value": _first(df, "estimated_value", "value"), "category": _first(df, "category"), "posted_date": _first(df, "posted_date"), "valid_from": _first(df, "posted_date", "issue_date"),
        "closing_date": _first(df, "closing_date", "closing_at", "deadline"), "tender_id": _first(df, "tender_id"), "url": _first(df, "url"), "status": _first(df, "status"),
    }, report=True)
    b.entity(df, "organization", organisation)
    b.relation(df, ("tender", title), "issued_by", ("organization", organisation), valid_from=_first(df, "posted_date"))
    b.relation(df, ("organization", organisation), "issues", ("tender", title))
    b.places(df, "tender", title, _first(df, "location", "region"))
    b.entity(df, "industry", _first(df, "category"))
    b.relation(df, ("tender", title), "in_industry", ("industry", _first(df, "category")))
    return b.done()


def _companies(b: Build, df: DataFrame) -> Delta:
    name = _first(df, "company_name", "company", "business_name", "name")
    b.entity(df, "company", name, {k: _first(df, k) for k in ("city", "province", "phone", "website", "address")}, report=True)
    for column, kind, edge in (("city", "city", "in_city"), ("province", "province", "in_province")):
        b.entity(df, kind, _first(df, column))
        b.relation(df, ("company", name), edge, (kind, _first(df, column)))
    return b.done()


def _awards(b: Build, df: DataFrame) -> Delta:
    winner, title = _first(df, "winner_company", "vendor_name", "winner", "awarded_to"), _first(df, "tender_title", "title")
    value, date = _first(df, "contract_value", "award_value", "value"), _first(df, "award_date", "date", "awarded_at")
    b.entity(df, "company", winner, report=True)
    b.entity(df, "tender", title, {"contract_value": value, "award_date": date, "url": _first(df, "url")})
    b.relation(df, ("company", winner), "awarded_to", ("tender", title), {"contract_value": value, "award_date": date}, valid_from=date)
    b.relation(df, ("tender", title), "awarded_by", ("company", winner))
    return b.done()


def _permits(b: Build, df: DataFrame) -> Delta:
    """Permits with their companies. Of ``Person DBA: Company`` the company is the applicant and the person its contact,
    a node of its own that is contact_for the company."""
    number = F.coalesce(_first(df, "external_id", "permit_number", "permit_no"), _first(df, "address"))
    raw = {"applied_for": _first(df, "applicant"), "contracted_for": _first(df, "contractor")}
    city, filed, issued = _first(df, "city"), _first(df, "application_date"), _first(df, "issue_date")
    b.entity(df, "permit", number, {k: _first(df, k) for k in ("address", "permit_type", "project_value", "issue_date", "application_date", "description", "local_area", "city")}, report=True)
    other = ~F.coalesce(F.lower(raw["applied_for"]) == F.lower(raw["contracted_for"]), F.lit(False))
    for edge, text in raw.items():
        when, since = (None, F.coalesce(filed, issued)) if edge == "applied_for" else (other, issued)
        name = F.coalesce(clean(F.regexp_extract(text, r"(?i)DBA:\s*(.+)$", 1)), text)
        person = clean(F.regexp_extract(text, r"(?i)^(.+?)\s+DBA:", 1)) if edge == "applied_for" else F.lit(None).cast("string")
        b.entity(df, "company", name, {"city": city, "contact_person": person}, when=when)
        b.relation(df, ("company", name), edge, ("permit", number), when=when, valid_from=since)
        b.relation(df, ("company", name), "in_city", ("city", city), when=when)
        if edge == "applied_for":
            b.entity(df, "person", person)
            b.relation(df, ("person", person), "contact_for", ("company", name))
    place = F.coalesce(city, _first(df, "local_area"))
    b.entity(df, "city", place)
    b.relation(df, ("permit", number), "in_city", ("city", place))
    return b.done()


#: Files of a data set folder, and how each is read.
DATASET = {"federal_tenders.csv": "tenders", "federal_tenders.json": "json", "buyer_tenders.csv": "tenders", "contract_awards.csv": "awards", "building_permits.csv": "permits", "companies.csv": "companies"}


def dataset(spark: SparkSession, folder: str, source: str = "dataset", limit: int | None = None) -> tuple[Delta, list[str]]:
    """All known files of a folder in their fixed order, and the names of those that are missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out, missing = None, []
    for k, (name, kind) in enumerate(DATASET.items()):
        path = os.path.join(folder, name)
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            missing.append(name)
            continue
        if kind == "json":
            df = _numbered(spark.read.option("multiLine", True).json(path))
            d = _tenders(Build(spark, source), df if limit is None else df.limit(limit))
        else:
            d = {"tenders": _tenders, "awards": _awards, "permits": _permits, "companies": _companies}[kind](Build(spark, source), _read(spark, path, limit))
        later = Delta(d.entities.withColumn("seq", F.col("seq") + F.lit(k << 58)), d.relations.withColumn("seq", F.col("seq") + F.lit(k << 58)), d.skipped)
        out = later if out is None else Delta(*[a.unionByName(b) for a, b in zip(out, later, strict=True)])
    return out or Build(spark, source).done(), missing


def _by_key(df: DataFrame, key: str = "id") -> DataFrame:
    """A relational table numbered by its integer key."""
    return df.withColumn("seq", F.col(key).cast("long"))


def companies_table(spark: SparkSession, df: DataFrame, source: str = "table") -> Delta:
    """A relational companies table: canonical and standalone rows become companies, applicant aliases become aliases with an
    edge to the company of their canonical id; persons, unknown roles and aliases without one are skipped."""
    df = _by_key(df)
    role = F.coalesce(F.lower(clean("entity_role")), F.lit("standalone"))
    name = F.coalesce(clean("display_name"), clean("name"))
    df = df.withColumns({"_role": role, "_name": name})
    b = Build(spark, source)
    main = df.filter(F.col("_role").isin("canonical", "standalone"))
    keep = ("total_projects", "total_award_value", "award_count", "primary_city", "primary_province", "google_address", "primary_trade", "dominant_sector")
    b.entity(main, "company", F.col("_name"), {"scraper_id": F.col("id").cast("string")} | {k: clean(k) for k in keep if k in df.columns}, report=True)
    alias = df.filter("_role = 'applicant_alias'").select("seq", "_name", F.col("id").cast("string").alias("own"), F.col("canonical_company_id").cast("string").alias("cid"))
    found = alias.join(main.select(F.col("id").cast("string").alias("cid"), F.col("_name").alias("_company")), "cid", "left")
    b.entity(found, "company_alias", F.col("_name"), {"scraper_id": F.col("own")}, when=F.col("_company").isNotNull())
    evidence = {"reason": F.lit("canonical_company_id"), "canonical_company_id": F.col("cid")}
    b.relation(found, ("company_alias", F.col("_name")), "alias_of", ("company", F.col("_company")), evidence, more={"target_id": F.col("cid")})
    b.lost.append(found.filter("_company is null").select("seq", F.lit("alias without company").alias("reason")))
    b.lost.append(df.filter(~F.col("_role").isin("canonical", "standalone", "applicant_alias")).select("seq", F.concat(F.lit("role "), F.col("_role")).alias("reason")))
    return b.done()


#: The tender tables, and in each the columns of buyer, deadline and value.
TENDER_TABLES = {
    "tenders": ("organization", "closing_date", "estimated_value"), "commercial_tenders": ("company", "deadline", "value"), "arch_tenders": ("company", "deadline", "value"),
}
#: Columns that each table must have.
NEEDED = {
    "companies": ("id", "display_name", "name", "entity_role", "canonical_company_id"), "tenders": ("id", "title", "organization"), "commercial_tenders": ("id", "title", "company"),
    "arch_tenders": ("id", "title", "company"), "permits": ("id", "external_id", "address", "company_id"), "contract_awards": ("id", "title", "external_id", "winner_company", "company_id"),
}


def tender_table(spark: SparkSession, df: DataFrame, table: str, source: str = "table") -> Delta:
    """A relational tender table: tenders with the table and key they come from; rows without a title are skipped."""
    buyer, deadline, value = TENDER_TABLES[table]
    df, b = _by_key(df), Build(spark, source)
    own = F.lit("arch_tenders") if table == "arch_tenders" else _first(df, "source")
    b.entity(df, "tender", F.col("title"), {
        "scraper_id": F.col("id"), "scraper_table": F.lit(table), "organization": _first(df, buyer), "category": _first(df, "category"), "closing_date": _first(df, deadline),
        "estimated_value": _first(df, value), "source": own, "tender_id": _first(df, "tender_id"), "url": _first(df, "url"),
    }, report=True)
    return b.done()


def permits_table(spark: SparkSession, df: DataFrame, source: str = "table") -> Delta:
    """A relational permits table: permits by external id, else address, else key, and has_permit edges from the company of
    ``company_id``. Without a known company there is no edge."""
    df, b = _by_key(df), Build(spark, source)
    name = F.coalesce(_first(df, "external_id"), _first(df, "address"), F.concat(F.lit("permit-"), F.col("id").cast("string")))
    keep = ("external_id", "address", "city", "permit_type", "project_value", "applicant", "contractor", "lifecycle_status", "source")
    b.entity(df, "permit", name, {"scraper_id": F.col("id")} | {k: _first(df, k) for k in keep})
    b.by_id(df, F.col("company_id"), "has_permit", ("permit", name))
    return b.done()


def awards_table(spark: SparkSession, df: DataFrame, source: str = "table") -> Delta:
    """A relational awards table: contracts by title, else external id, else key, with an edge from the company of
    ``company_id`` and one to the winner by name. No company is made: a winner that is not known is a rejected row."""
    df, b = _by_key(df), Build(spark, source)
    name = F.coalesce(_first(df, "title"), _first(df, "external_id"), F.concat(F.lit("award-"), F.col("id").cast("string")))
    keep = ("external_id", "winner_company", "award_value", "currency", "award_date", "buyer_organization", "procurement_category", "source")
    b.entity(df, "contract", name, {"scraper_id": F.col("id")} | {k: _first(df, k) for k in keep})
    b.by_id(df, F.col("company_id"), "awarded_to", ("contract", name), {"award_date": _first(df, "award_date"), "award_value": _first(df, "award_value")})
    b.relation(df, ("contract", name), "awarded_to", ("company", _first(df, "winner_company")))
    return b.done()


def organizations(spark: SparkSession, tables: dict[str, DataFrame], source: str = "table") -> Delta:
    """The distinct buyers of all tender tables as organisations, in the order of their names."""
    names = None
    for table, (buyer, _, _) in TENDER_TABLES.items():
        if table in tables:
            mine = tables[table].select(clean(buyer).alias("name")).filter("name is not null")
            names = mine if names is None else names.unionByName(mine)
    b = Build(spark, source)
    if names is not None:
        b.entity(numbered(names.distinct(), F.col("name")).withColumnRenamed("n", "seq"), "organization", F.col("name"))
    return b.done()


def missing_columns(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """What a relational import of these tables lacks: the needed columns that a table doesn't have."""
    lack = {t: [c for c in NEEDED[t] if c not in df.columns] for t, df in tables.items() if t in NEEDED}
    return {t: c for t, c in lack.items() if c}


def relational(spark: SparkSession, tables: dict[str, DataFrame], source: str = "table") -> list[tuple[str, Delta]]:
    """The stages of a relational import, in the order in which they must be loaded: companies with their aliases first,
    so that permits and awards find them, then tenders, permits, awards and buyers. Tables that are not given are passed over."""
    if lack := missing_columns(tables):
        raise ValueError(f"missing columns: {lack}")
    out = [("companies", companies_table(spark, tables["companies"], source))] if "companies" in tables else []
    out += [(t, tender_table(spark, tables[t], t, source)) for t in TENDER_TABLES if t in tables]
    out += [(t, f(spark, tables[t], source)) for t, f in (("permits", permits_table), ("contract_awards", awards_table)) if t in tables]
    return [*out, ("organizations", organizations(spark, tables, source))] if set(tables) & set(TENDER_TABLES) else out


def jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A relational table read in ranges of an integer key, in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options)
    return reader.load()


def page(df: DataFrame, key: str, after: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows after a key in its order, at most ``size``, and (next_after, has_more) to go on from."""
    rows = df.filter(F.col(key) > after).orderBy(key).limit(size)
    state = df.filter(F.col(key) > after).orderBy(key).limit(size + 1).agg(F.count("*").alias("n"))
    last = rows.agg(F.coalesce(F.max(key), F.lit(after)).alias("next_after"))
    return rows, last.crossJoin(state).select("next_after", (F.col("n") > size).alias("has_more"))
