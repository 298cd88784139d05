"""Company analytics: activity, values, buyers, competitors, contracts, timelines, places and industries of all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .competitive import _top
from .views import Graph

_NEW = ("awarded_to", "submitted_bid")


def _edges(g: Graph, out: tuple = (), kinds_of: tuple = ("tender",)) -> DataFrame:
    """Out-edges of companies to nodes of some kinds, with the other node's name, kind and attributes."""
    e = g.edges(*out).filter(X.is_kind("source_uid", "company") & X.is_kind("target_uid", *kinds_of))
    other = g.nodes(*kinds_of).select(F.col("uid").alias("other"), F.col("name").alias("other_name"), F.col("kind").alias("other_kind"), F.col("attributes").alias("b"))
    e = e.select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("other"), F.col("kind").alias("relation"), F.col("attributes").alias("a"), "valid_from", F.col("source").alias("edge_source"), F.col("confidence").alias("edge_confidence"))
    return e.join(other, "other")


def _value(*columns) -> Column:
    """The first truthy text as money; 0 counts as none."""
    v = X.money(F.coalesce(*[X.truthy(c) for c in columns]))
    return F.when(v != 0, v)


def summary(g: Graph) -> DataFrame:
    """(uid, name, confidence_score, evidence_count, tenders_won, tenders_submitted, permits, unique_buyers, location_count, industry_count,
    total_awarded_value, average_contract_value, largest_contract) over a company's edges.

    The value of an award is its own contract value, else the tender's; a permit counts by applied_for, contracted_for and has_permit."""
    p = g.participation.filter(F.col("role").isin(*_NEW)).join(g.facts.select("tender", "award_value"), "tender")
    v = F.when(F.col("is_win"), F.coalesce(X.money(X.truthy("contract_value")), F.col("award_value")))
    v = F.when(v != 0, v)
    won = p.groupBy(F.col("company").alias("uid")).agg(
        F.count_if("is_win").alias("tenders_won"), F.count_if(~F.col("is_win")).alias("tenders_submitted"), F.coalesce(X.rounded(F.sum(v), 2), F.lit(0.0)).alias("total_awarded_value"),
        F.coalesce(X.rounded(F.avg(v), 2), F.lit(0.0)).alias("average_contract_value"), F.coalesce(X.rounded(F.max(v), 2), F.lit(0.0)).alias("largest_contract"),
    )
    around = g.adjacency.filter(X.is_kind("uid", "company")).groupBy("uid").agg(
        F.count("*").alias("evidence_count"),
        F.count_if(X.is_kind("other", "permit") & F.col("relation").isin("applied_for", "contracted_for", "has_permit")).alias("permits"),
        F.count_distinct(F.when(X.is_kind("other", "organization"), F.col("other"))).alias("direct_buyers"),
        F.count_distinct(F.when(X.is_kind("other", "city", "province"), F.col("other"))).alias("location_count"),
        F.count_distinct(F.when(X.is_kind("other", "industry"), F.col("other"))).alias("industry_count"),
    )
    out = g.names("company").join(around, "uid", "left").join(won, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "uid", "name", X.rounded(F.least(F.lit(1.0), 0.3 + 0.07 * F.least(F.lit(10), F.coalesce("evidence_count", F.lit(0)))), 3).alias("confidence_score"), zero("evidence_count"), zero("tenders_won"), zero("tenders_submitted"),
        zero("permits"), F.coalesce("direct_buyers", F.lit(0)).alias("unique_buyers"), zero("location_count"), zero("industry_count"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_awarded_value", "average_contract_value", "largest_contract")],
    )


def _valued(g: Graph) -> DataFrame:
    """(uid, year, contract, permit): each tender and permit edge with its value, if it has one."""
    contracts = _edges(g, ("awarded_to", "submitted_bid", "has_contract", "applied_for", "contracted_for"))
    date = F.coalesce(X.truthy(F.col("a")["award_date"]), X.truthy(F.col("b")["award_date"]), F.col("valid_from"))
    contracts = contracts.select("uid", date.alias("date"), F.lit(True).alias("is_contract"), _value(F.col("a")["contract_value"], F.col("b")["contract_value"], F.col("b")["estimated_value"]).alias("v"))
    permits = _edges(g, ("applied_for", "contracted_for", "has_permit"), ("permit",))
    date = F.coalesce(X.truthy(F.col("b")["issue_date"]), X.truthy(F.col("b")["application_date"]))
    permits = permits.select("uid", date.alias("date"), F.lit(False).alias("is_contract"), _value(F.col("b")["project_value_numeric"], F.col("b")["project_value"]).alias("v"))
    return contracts.unionByName(permits)


def stats(g: Graph) -> DataFrame:
    """(uid, contract_count, total_contract_value, average_contract_value, largest_contract, smallest_contract, permit_count,
    total_permit_value, total_value, first_activity, latest_activity): only edges with a value count; bids with one count as contracts."""
    c, p = F.when(F.col("is_contract"), F.col("v")), F.when(~F.col("is_contract"), F.col("v"))
    money = lambda x: F.coalesce(X.rounded(x, 2), F.lit(0.0))
    return _valued(g).groupBy("uid").agg(
        F.count(c).alias("contract_count"), money(F.sum(c)).alias("total_contract_value"), money(F.avg(c)).alias("average_contract_value"), money(F.max(c)).alias("largest_contract"), money(F.min(c)).alias("smallest_contract"),
        F.count(p).alias("permit_count"), money(F.sum(p)).alias("total_permit_value"), money(F.sum("v")).alias("total_value"), F.min("date").alias("first_activity"), F.max("date").alias("latest_activity"),
    )


def yearly_stats(g: Graph) -> DataFrame:
    """(uid, year, contract_count, contract_value, permit_count, permit_value): all edges count here; a missing date is ``unknown``."""
    year = F.when(F.length("date") >= 4, F.substring("date", 1, 4)).otherwise("unknown")
    v = lambda c: F.coalesce(X.rounded(F.sum(F.when(c, F.col("v"))), 2), F.lit(0.0))
    return _valued(g).groupBy("uid", year.alias("year")).agg(F.count_if("is_contract").alias("contract_count"), v(F.col("is_contract")).alias("contract_value"), F.count_if(~F.col("is_contract")).alias("permit_count"), v(~F.col("is_contract")).alias("permit_value"))


def _buyers(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(uid, buyer): of each tender that a company won or bid on, the organisations that issued it; and those linked to it directly."""
    mine = g.participation.filter(F.col("role").isin(*_NEW)).select("company", "tender").distinct()
    out = mine.join(g.issued.filter(X.is_kind("buyer", "organization")), "tender").select(F.col("company").alias("uid"), "buyer")
    direct = g.edges("awarded_by", "issues").filter(X.is_kind("source_uid", "organization") & X.is_kind("target_uid", "company"))
    return out, direct.select(F.col("target_uid").alias("uid"), F.col("source_uid").alias("buyer"))


def buyers(g: Graph) -> DataFrame:
    """(uid, buyer, tender_count): organisations that issued tenders the company won or bid on, and those linked to it directly with 0."""
    out, direct = _buyers(g)
    out = out.groupBy("uid", "buyer").agg(F.count("*").alias("n")).unionByName(direct.withColumn("n", F.lit(0).cast("long")))
    return out.groupBy("uid", "buyer").agg(F.max("n").alias("tender_count"))


def single_buyer(g: Graph) -> DataFrame:
    """(uid, single_buyer): whether the company has one buyer alone (``buyers``), told by the least and the greatest of them."""
    out, direct = _buyers(g)
    return out.unionByName(direct).groupBy("uid").agg((F.min("buyer") == F.max("buyer")).alias("single_buyer"))


def bid_counts(g: Graph) -> DataFrame:
    """(uid, bid_count): tenders won and submitted as ``summary`` counts them; companies without any have no row."""
    p = g.participation.filter(F.col("role").isin(*_NEW)).select("company", "tender").join(g.facts.select("tender"), "tender")
    return p.groupBy(F.col("company").alias("uid")).agg(F.count("*").alias("bid_count"))


def competitors(g: Graph, limit: int | None = 20) -> DataFrame:
    """(uid, rival, shared_tenders, shared_buyers, shared_evidence_count): winners of tenders the company won or bid on, and
    winners of tenders that those tenders' buyers issue by ``issues`` edges."""
    mine = g.participation.filter(F.col("role").isin(*_NEW)).select("company", "tender").distinct()
    won = g.participation.filter("is_win").select(F.col("company").alias("rival"), "tender")
    t = mine.join(won, "tender").filter("company <> rival").groupBy("company", "rival").agg(F.count("*").alias("t"))
    issues = g.edges("issues").filter(X.is_kind("target_uid", "tender")).select(F.col("source_uid").alias("buyer"), F.col("target_uid").alias("tender"))
    near = mine.join(g.issued, "tender").select("company", "buyer").distinct()
    far = issues.join(won, "tender").select("buyer", "rival").distinct()
    b = near.join(far, "buyer").filter("company <> rival").groupBy("company", "rival").agg(F.count("*").alias("b"))
    n = lambda c: F.coalesce(c, F.lit(0))
    out = t.join(b, ["company", "rival"], "full_outer").select(F.col("company").alias("uid"), "rival", n("t").alias("shared_tenders"), n("b").alias("shared_buyers"), (n("t") + n("b")).alias("shared_evidence_count"))
    return _top(out, "uid", [F.desc("shared_evidence_count"), "rival"], limit)


def contracts(g: Graph) -> DataFrame:
    """(uid, contract, entity_kind, relation, contract_value, award_date, url): won tenders and contracts."""
    e = _edges(g, ("awarded_to", "has_contract"), ("tender", "contract"))
    date = F.coalesce(X.truthy(F.col("a")["award_date"]), X.truthy(F.col("b")["award_date"]), F.col("valid_from"))
    return e.select("uid", F.col("other").alias("contract"), F.col("other_kind").alias("entity_kind"), "relation", X.money(F.coalesce(*[X.truthy(x) for x in (F.col("a")["contract_value"], F.col("b")["contract_value"], F.col("b")["estimated_value"])])).alias("contract_value"), date.alias("award_date"), F.col("b")["url"].alias("url"))


def contract_totals(g: Graph) -> DataFrame:
    """(uid, contract_count, total_value, average_value, largest_contract): the average is over all contracts, valued or not."""
    v = F.coalesce("contract_value", F.lit(0.0))
    return contracts(g).groupBy("uid").agg(F.count("*").alias("contract_count"), X.rounded(F.sum(v), 2).alias("total_value"), X.rounded(F.sum(v) / F.count("*"), 2).alias("average_value"), F.max(v).alias("largest_contract"))


def tenders(g: Graph) -> DataFrame:
    """(uid, tender, relation, category, closing_date, contract_value, won): every tender edge of a company."""
    p = g.participation.join(g.facts.select("tender", "category", "deadline"), "tender")
    return p.select(F.col("company").alias("uid"), "tender", F.col("role").alias("relation"), "category", F.col("deadline").alias("closing_date"), X.money("contract_value").alias("contract_value"), F.col("is_win").alias("won"))


def timeline(g: Graph) -> DataFrame:
    """(uid, date, event_type, counterpart): dated edges from both sides; the edge's date, else the tender's, permit's or contract's own."""
    r = g.relations.select("source_uid", "target_uid", "kind", "valid_from")
    both = r.select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("counterpart"), "kind", "valid_from").unionByName(r.select(F.col("target_uid").alias("uid"), F.col("source_uid").alias("counterpart"), "kind", "valid_from"))
    both = both.filter(X.is_kind("uid", "company") & X.is_kind("counterpart", "tender", "permit", "contract") | X.is_kind("uid", "company") & F.col("valid_from").isNotNull())
    b = F.col("attributes")
    own = F.when(F.col("kind") == "tender", X.first_truthy(b, "award_date", "closing_date", "posted_date")).when(F.col("kind") == "permit", X.first_truthy(b, "issue_date", "application_date")).otherwise(X.first_truthy(b, "date", "award_date"))
    dates = g.nodes("tender", "permit", "contract").select(F.col("uid").alias("counterpart"), own.alias("own"))
    date = F.coalesce(X.truthy("valid_from"), F.col("own"))
    return both.join(dates, "counterpart", "left").select("uid", F.substring(date, 1, 10).alias("date"), F.col("kind").alias("event_type"), "counterpart").filter("date is not null")


def yearly_activity(g: Graph) -> DataFrame:
    """(uid, year, events, first_event, latest_event)."""
    return timeline(g).groupBy("uid", F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("events"), F.min("date").alias("first_event"), F.max("date").alias("latest_event"))


def locations(g: Graph) -> DataFrame:
    """(uid, location, relation, name): places by edges; a company without any has its city and province attributes with no uid."""
    named = g.locations.join(g.entities.select(F.col("uid").alias("location"), "name"), "location").select(F.col("company").alias("uid"), "location", "relation", "name")
    a = F.col("attributes")
    lone = g.nodes("company").join(named.select("uid").distinct(), "uid", "left_anti")
    fall = lone.select("uid", F.explode(F.array(*[F.struct(F.lit(None).cast("string").alias("location"), F.lit(r).alias("relation"), X.first_truthy(a, *k).alias("name")) for r, k in (("in_city", ("city", "primary_city")), ("in_province", ("province", "primary_province")), ("has_address", ("address", "google_address", "primary_address")))])).alias("x"))
    return named.unionByName(fall.select("uid", "x.*").filter("name is not null"))


def industries(g: Graph) -> DataFrame:
    """(uid, name, inferred, evidence_count, example_tender): industries by edges, and categories of won tenders as inferred ones."""
    own = g.edges("in_industry", "has_naics").filter(X.is_kind("source_uid", "company")).select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("i"))
    own = own.join(g.names("industry", "naics").withColumnRenamed("uid", "i"), "i").groupBy("uid", "name").agg(F.lit(False).alias("inferred"), F.count("*").alias("evidence_count"), F.lit(None).cast("string").alias("example_tender"))
    won = g.participation.filter("is_win").join(g.facts.select("tender", "category"), "tender").filter(X.truthy("category").isNotNull())
    guess = won.groupBy(F.col("company").alias("uid"), F.col("category").alias("name")).agg(F.lit(True).alias("inferred"), F.count("*").alias("evidence_count"), F.min("tender").alias("example_tender"))
    return own.unionByName(guess)


def top_competitors(g: Graph, limit: int = 20) -> DataFrame:
    """(uid, buyer_count): companies by distinct buyers reached through awards."""
    n = g.participation.filter("is_win").join(g.issued, "tender").groupBy(F.col("company").alias("uid")).agg(F.count_distinct("buyer").alias("buyer_count"))
    return n.orderBy(F.desc("buyer_count"), "uid").limit(limit)


def companies_in(g: Graph, kind: str, name: str | None = None) -> DataFrame:
    """(place, place_name, uid, name): companies of each city or province, or of those whose name holds ``name``."""
    places = g.names(kind) if name is None else g.names(kind).filter(X.canonical("name").contains(name.strip().lower()))
    members = (g.cities if kind == "city" else g.provinces).withColumnRenamed(kind, "place")
    return members.join(places.select(F.col("uid").alias("place"), F.col("name").alias("place_name")), "place").join(g.names("company").withColumnRenamed("uid", "company"), "company").select("place", "place_name", F.col("company").alias("uid"), "name")


def most_connected(g: Graph, limit: int = 20) -> DataFrame:
    """(uid, out_edges, in_edges, total_edges): companies by number of edges."""
    n = g.adjacency.filter(X.is_kind("uid", "company")).groupBy("uid").agg(F.count_if(F.col("direction") == "out").alias("out_edges"), F.count_if(F.col("direction") == "in").alias("in_edges"), F.count("*").alias("total_edges"))
    return n.orderBy(F.desc("total_edges"), "uid").limit(limit)


def profile(g: Graph) -> DataFrame:
    """A struct for each sub-report with one row a company."""
    out = summary(g).select("uid", F.struct("*").alias("summary"))
    for name, df in (("stats", stats(g)), ("contracts", contract_totals(g)), ("buyers", buyers(g).groupBy("uid").agg(F.count("*").alias("buyer_count")))):
        out = out.join(df.select("uid", F.struct("*").alias(name)), "uid", "left")
    return out
