"""Relationship analytics: what two entities share, how strong that is, and what it lets one infer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import stored
from .competitive import _top
from .pairs import Kind, counted
from .views import Graph

_EVENTS = ("awarded_to", "submitted_bid", "participated_in", "contracted_for", "applied_for")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("uid_a", "uid_b").alias("uid_a"), F.greatest("uid_a", "uid_b").alias("uid_b")).distinct()


def _shared(members: DataFrame, key: str, name: str, pairs: DataFrame | None) -> DataFrame:
    """(uid_a, uid_b, name): how many ``key`` two companies have both; uid_a < uid_b.

    Given pairs come first: their companies' keys are joined, so a key of very many members costs no more than the
    pairs that have it. Without them the result is all pairs that share a key, counted in blocks of companies."""
    if pairs is None:
        return counted({name: Kind(members.select("company", key))}, ordered=True).named("uid_a", "uid_b")
    m = members.select("company", key).distinct()
    out = _ordered(pairs).filter("uid_a < uid_b").join(m.withColumnRenamed("company", "uid_a"), "uid_a").join(m.withColumnRenamed("company", "uid_b"), ["uid_b", key])
    return out.groupBy("uid_a", "uid_b").agg(F.count("*").alias(name))


def company_buyers(g: Graph) -> DataFrame:
    """(company, buyer) by awards and bids."""
    return g.participation.filter(F.col("role").isin("awarded_to", "submitted_bid")).join(g.issued, "tender").select("company", "buyer").distinct()


def shared_buyers(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(uid_a, uid_b, shared_buyer_count)."""
    return _shared(company_buyers(g), "buyer", "shared_buyer_count", pairs)


def _places(g: Graph) -> DataFrame:
    return g.locations.filter(F.col("relation").isin("in_city", "in_province"))


def company_events(g: Graph) -> DataFrame:
    """(company, event): edges with tenders, permits and other events, either way."""
    events = g.edges(*_EVENTS)
    out = events.filter(X.is_kind("source_uid", "company")).select(F.col("source_uid").alias("company"), F.col("target_uid").alias("event"))
    back = events.filter(X.is_kind("target_uid", "company")).select(F.col("target_uid").alias("company"), F.col("source_uid").alias("event"))
    return out.unionByName(back)


def shared_tenders(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(uid_a, uid_b, co_appearances): events that both have an edge with."""
    return _shared(company_events(g), "event", "co_appearances", pairs)


def shared_industries(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    return _shared(g.industries, "industry", "shared_industry_count", pairs)


def shared_locations(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    return _shared(_places(g), "location", "shared_location_count", pairs)


def _rivals(g: Graph, far: bool) -> Kind:
    """Companies on a tender, and as thirds those that won or bid on it; with ``far``, also those that each meets on its own tenders."""
    on = g.participation.select("company", "tender")
    third = g.participation.filter(F.col("role").isin("awarded_to", "submitted_bid")).select("company", "tender")
    met = on.distinct().join(third.withColumnRenamed("company", "c").distinct(), "tender").filter("company <> c").select("company", "c")
    return Kind(on, third=third, far=met.distinct() if far else None)


def shared_competitors(g: Graph, pairs: DataFrame | None = None, far: bool = False) -> DataFrame:
    """(uid_a, uid_b, shared_competitor_count): third companies that won or bid on tenders both take part in.

    For pairs without a common tender, those that each of them meets on its own tenders: of given pairs always, of all
    pairs with ``far``."""
    if pairs is None:
        return counted({"shared_competitor_count": _rivals(g, far)}, ordered=True).named("uid_a", "uid_b").filter("shared_competitor_count > 0")
    t = g.participation.select("company", "tender").distinct()
    third = g.participation.filter(F.col("role").isin("awarded_to", "submitted_bid")).select(F.col("company").alias("c"), "tender").distinct()
    ordered = _ordered(pairs)
    both = ordered.filter("uid_a < uid_b").join(t.withColumnRenamed("company", "uid_a"), "uid_a").join(t.withColumnRenamed("company", "uid_b"), ["uid_b", "tender"])
    meet = both.join(third, "tender").groupBy("uid_a", "uid_b").agg(F.count_distinct(F.when((F.col("c") != F.col("uid_a")) & (F.col("c") != F.col("uid_b")), F.col("c"))).alias("shared_competitor_count"))
    lone = ordered.join(meet.select("uid_a", "uid_b"), ["uid_a", "uid_b"], "left_anti")
    rivals = t.join(third, "tender").filter("company <> c").select("company", "c").distinct()
    far = lone.join(rivals.withColumnRenamed("company", "uid_a"), "uid_a").join(rivals.withColumnRenamed("company", "uid_b"), ["uid_b", "c"])
    return meet.unionByName(far.groupBy("uid_a", "uid_b").agg(F.count("*").alias("shared_competitor_count"))).filter("shared_competitor_count > 0")


def direct_relations(g: Graph) -> DataFrame:
    """(uid_a, uid_b, direct_count, weights): edges between two companies, either way."""
    e = g.relations.filter(X.is_kind("source_uid", "company") & X.is_kind("target_uid", "company"))
    return e.groupBy(F.least("source_uid", "target_uid").alias("uid_a"), F.greatest("source_uid", "target_uid").alias("uid_b")).agg(F.count("*").alias("direct_count"), F.collect_list(X.weight("kind")).alias("weights"))


def strength(g: Graph, pairs: DataFrame | None = None, far: bool = False) -> DataFrame:
    """(uid_a, uid_b, shared counts, evidence_count, relationship_strength, confidence) of all pairs with any signal, or of ``pairs``.

    ``far`` as in ``shared_competitors``.
    Direct edges weigh by kind, every shared buyer, competitor, industry, place and event 0.3; weights fall off by 0.7
    a piece, the strongest first. Beyond sixty pieces the rest can't change four digits."""
    on = ["uid_a", "uid_b"]
    counts = {"shared_buyer_count": shared_buyers, "shared_competitor_count": shared_competitors, "shared_industry_count": shared_industries, "shared_location_count": shared_locations, "co_appearances": shared_tenders}
    direct = direct_relations(g)
    if pairs is None:
        direct = stored(direct, "direct")
        ends = direct.select(F.explode(F.array(*on)).alias("company"), F.concat_ws(":", *on).alias("key"))
        kinds = {"shared_buyer_count": Kind(company_buyers(g)), "shared_competitor_count": _rivals(g, far), "shared_industry_count": Kind(g.industries), "shared_location_count": Kind(_places(g).select("company", "location")), "co_appearances": Kind(company_events(g)), "_direct": Kind(ends)}
        found = counted(kinds, ordered=True).named(*on)
        found = found.filter(" + ".join(kinds) + " > 0").drop("_direct")  # companies on a tender without any third or event
        out = found.join(direct, on, "left").unionByName(direct.filter("uid_a = uid_b"), allowMissingColumns=True)
    else:
        out = direct
        for f in counts.values():
            out = out.join(f(g, pairs), on, "full_outer")
        out = out.join(_ordered(pairs), on, "right")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in (*counts, "direct_count")})
    soft = sum([F.col(c) for c in counts], F.lit(0))
    pieces = F.least(soft, F.lit(60))
    weights = F.concat("weights", F.array_repeat(F.lit(0.3), pieces.cast("int")))
    out = out.withColumn("evidence_count", soft + F.col("direct_count")).withColumn("relationship_strength", F.when(F.col("weights").isNull(), X.equal_strength(pieces, 0.3)).otherwise(X.strength(weights)))
    return out.select(*on, *counts, "direct_count", "evidence_count", "relationship_strength", X.strength_confidence("relationship_strength", "evidence_count").alias("confidence"))


#: Words for each signal of a pair, in the order in which ``explain`` names them.
SIGNALS = {
    "direct_count": "direct edges", "co_appearances": "common events", "shared_buyer_count": "common buyers", "shared_industry_count": "common industries",
    "shared_location_count": "common places", "shared_competitor_count": "common competitors",
}


def explain(g: Graph, pairs: DataFrame | None = None, far: bool = False) -> DataFrame:
    """``strength`` with a text that counts each signal that there is."""
    text = F.concat_ws("; ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}"))) for c, what in SIGNALS.items()])
    return strength(g, pairs, far).withColumn("explanation_text", F.when(text == "", "nothing in common").otherwise(text))


def _links(df: DataFrame, count: str, weight: float, limit: int | None) -> DataFrame:
    out = df.withColumn("strength", X.equal_strength(count, weight)).withColumn("confidence", X.strength_confidence("strength", count))
    return _top(out, "uid", [F.desc(count), "other"], limit)


def infer_relationships(g: Graph, limit: int | None = 50) -> DataFrame:
    """(uid, other, family, n, strength, confidence): five families of inferred links, each the strongest ``limit`` of a company."""
    won = g.participation.filter("is_win").select("company", "tender")
    best = lambda members: counted({"n": Kind(members)}, most=None if limit is None else ({"n": 1}, limit)).named("uid", "other")
    families = {"shared_buyer": (best(company_buyers(g)), 0.3)}
    part = g.participation.filter("role <> 'awarded_to'").select(F.col("company").alias("uid"), "tender").join(won.withColumnRenamed("company", "other"), "tender").filter("uid <> other")
    families["subcontractor_hint"] = (part.groupBy("uid", "other").agg(F.count("*").alias("n")), 0.6)
    partner = won.withColumnRenamed("company", "uid").join(won.withColumnRenamed("company", "other"), "tender").filter("uid <> other")
    families["recurring_partnership"] = (partner.groupBy("uid", "other").agg(F.count("*").alias("n")).filter("n >= 2"), 1.0)
    families["industry_cluster_peer"] = (best(g.industries), 0.4)
    families["geographic_cluster_peer"] = (best(_places(g).select("company", "location")), 0.3)
    out = None
    for name, (df, weight) in families.items():
        mine = _links(df.select("uid", "other", "n"), "n", weight, limit).withColumn("family", F.lit(name))
        out = mine if out is None else out.unionByName(mine)
    return out


def _others(members: DataFrame, limit: int) -> DataFrame:
    """(uid, n): how many other companies share a key with each, ``limit`` at most.

    Of each key the first ``limit`` + 1 companies are looked at: one with more has that many others in any case."""
    m = members.toDF("uid", "key").filter("uid is not null and key is not null").distinct()
    first = _top(m, "key", ["uid"], limit + 1).withColumnRenamed("uid", "other")
    met = m.join(first, "key").filter("uid <> other").select("uid", "other").distinct()
    return met.groupBy("uid").agg(F.least(F.count("*"), F.lit(limit).cast("long")).alias("n"))


def _partners(kind: Kind, min_count: int, limit: int) -> DataFrame:
    """(uid, n): how many others share at least ``min_count`` of a kind with each company, ``limit`` at most; pairs stay where they are counted."""
    found = counted({"n": kind})
    n = found.pairs.filter(F.col("n") >= min_count).groupBy("a").agg(F.least(F.count("*"), F.lit(limit).cast("long")).alias("n"))
    return n.join(found.numbers.select(F.col("n").alias("a"), "uid"), "a").select("uid", "n")


def inferred_count(g: Graph, limit: int) -> DataFrame:
    """(uid, inferred_count): how many links ``infer_relationships(g, limit)`` has of each company, ``limit`` at most.

    Families by place and industry come first; the others are counted for companies that still have fewer."""
    won = g.participation.filter("is_win").select("company", "tender")
    places = _places(g).select("company", "location")
    out = g.names("company").select("uid").unionByName(g.participation.select(F.col("company").alias("uid"))).distinct().withColumn("n", F.lit(0).cast("long"))
    steps = (
        lambda few: _others(places, limit), lambda few: _others(g.industries, limit),
        lambda few: _partners(Kind(few(company_buyers(g)), company_buyers(g)), 1, limit),
        lambda few: _partners(Kind(few(g.participation.filter("role <> 'awarded_to'")).select("company", "tender"), won), 1, limit),
        lambda few: _partners(Kind(few(won), won, edges=True), 2, limit),
    )
    for step in steps:
        left = out.filter(F.col("n") < limit).select(F.col("uid").alias("company"))
        if not left.limit(1).count():
            break
        found = step(lambda df: df.join(left, "company", "left_semi"))
        out = out.unionByName(found).groupBy("uid").agg(F.least(F.sum("n"), F.lit(limit).cast("long")).alias("n"))
        out = stored(out, "inferred")
    return out.select("uid", F.col("n").alias("inferred_count"))


def partner_count(g: Graph, limit: int) -> DataFrame:
    """(uid, partner_count): how many others each company meets at any event (``recurring_partnerships`` from one on), ``limit`` at most."""
    mine = company_events(g).select("company", "event")
    return _partners(Kind(mine, g.participation.select("company", "tender")), 1, limit).withColumnRenamed("n", "partner_count")


def recurring_partnerships(g: Graph, min_count: int = 2, limit: int | None = None) -> DataFrame:
    """(uid, other, co_event_count, strength, confidence): meetings at any event, edges counted, at least ``min_count``."""
    e = g.edges(*_EVENTS)
    mine = e.filter(X.is_kind("source_uid", "company")).select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("event")).unionByName(e.filter(X.is_kind("target_uid", "company")).select(F.col("target_uid").alias("uid"), F.col("source_uid").alias("event")))
    theirs = g.participation.select(F.col("company").alias("other"), F.col("tender").alias("event"))
    n = mine.join(theirs, "event").filter("uid <> other").groupBy("uid", "other").agg(F.count("*").alias("co_event_count")).filter(F.col("co_event_count") >= min_count)
    return _links(n, "co_event_count", 1.0, limit)


def industry_clusters(g: Graph) -> DataFrame:
    """(industry, uid, tender_count, strength): companies of each industry by awards."""
    won = g.participation.filter("is_win").groupBy("company").agg(F.count("*").alias("n"))
    out = g.industries.join(won, "company", "left").withColumn("tender_count", F.coalesce("n", F.lit(0)))
    return out.select("industry", F.col("company").alias("uid"), "tender_count", X.equal_strength("tender_count", 1.0).alias("strength"))


def geographic_clusters(g: Graph) -> DataFrame:
    """(location, uid, name): companies of each city and province."""
    return _places(g).join(g.names("company").withColumnRenamed("uid", "company"), "company").select("location", F.col("company").alias("uid"), "name")


def organization_influence(g: Graph) -> DataFrame:
    """(org, tender_count, company_count, total_contract_value, influence_score) of each issuing organisation."""
    v = g.facts.select("tender", F.col("award_value"))
    t = g.issued.join(v, "tender", "left").groupBy("buyer").agg(F.count("*").alias("tender_count"), F.coalesce(X.rounded(F.sum("award_value"), 2), F.lit(0.0)).alias("total_contract_value"))
    c = company_buyers(g).groupBy("buyer").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return t.join(c, "buyer", "left").select(F.col("buyer").alias("org"), "tender_count", n.alias("company_count"), "total_contract_value", X.rounded(F.least(F.lit(1.0), 0.1 * n), 4).alias("influence_score"))


def subcontractor_chains(g: Graph, depth: int = 2, limit: int = 50) -> DataFrame:
    """(uid, chain, length): chains of two to ``depth`` companies by participated_in, works_with and contracted_for edges, no company twice."""
    e = g.adjacency.filter(F.col("relation").isin("participated_in", "works_with", "contracted_for") & X.is_kind("uid", "company") & X.is_kind("other", "company")).select("uid", "other").distinct()
    step = e.select(F.col("uid").alias("start"), F.col("other").alias("end"), F.array("other").alias("chain"))
    out = None
    for _ in range(depth - 1):
        step = step.join(e.select(F.col("uid").alias("end"), F.col("other").alias("next")), "end").filter("next <> start and not array_contains(chain, next)")
        step = step.select("start", F.col("next").alias("end"), F.concat("chain", F.array("next")).alias("chain"))
        out = step if out is None else out.unionByName(step)
    out = (step.limit(0) if out is None else out).select(F.col("start").alias("uid"), "chain", F.size("chain").alias("length"))
    return _top(out, "uid", ["length", "chain"], limit)
