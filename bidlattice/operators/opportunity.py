"""Opportunity scoring: ten dimensions of a company's fit with a tender, labels, risks, timelines and similar tenders.

Functions take ``pairs`` (company, tender) and return a row for each; features are computed once per company, tender,
buyer, (company, buyer) and (company, set of industries) and joined. Scores are 0 to 100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..session import stored
from . import best as _best
from . import store
from .views import Graph

#: Weight of each dimension.
WEIGHTS = {
    "capability": 15, "buyer_history": 15, "industry_history": 10, "value_fit": 10, "geo_fit": 10,
    "competition": 10, "buyer_attractiveness": 10, "strategic": 10, "workload": 5, "win_probability": 5,
}
_BUCKETS = [b for b, _ in X.OPPORTUNITY_BUCKETS]


def taking_part(g: Graph) -> DataFrame:
    """Each company with each tender it takes part in, dealt by tender."""
    if "taking_part" not in g._made:  # not stored: it is read as fast from participation
        g._made["taking_part"] = g.participation.select("company", "tender").repartition("tender").distinct()
    return g._made["taking_part"]


def open_tenders(g: Graph) -> DataFrame:
    """Tenders whose deadline has not passed; those without one count as open."""
    return g.facts.filter(F.col("deadline").isNull() | (F.substring("deadline", 1, 10) >= g.as_of)).select("tender")


def every_pair(g: Graph, companies: DataFrame | None = None, open_only: bool = True) -> DataFrame:
    """All companies (or the given ones) with all open tenders, or all tenders: the one product this library has."""
    c = g.names("company").select(F.col("uid").alias("company")) if companies is None else companies.select("company").distinct()
    return c.crossJoin(open_tenders(g) if open_only else g.facts.select("tender"))


def tender_industries(g: Graph) -> DataFrame:
    """(tender, inds): sorted industries of all companies on a tender."""
    return taking_part(g).join(g.industries, "company").groupBy("tender").agg(F.array_sort(F.collect_set("industry")).alias("inds"))


def _words(g: Graph) -> int:
    """64-bit words that hold a bit for each industry."""
    if not hasattr(g, "_industry_words"):
        g._industry_words = max(1, -(-_numbers(g).count() // 64))
    return g._industry_words


def _numbers(g: Graph) -> DataFrame:
    """(industry, k) with k = 0, 1, ...: industries that companies are in, a dimension."""
    return g.once("industry_numbers", lambda: store.numbered(g.industries.select("industry").distinct(), F.col("industry")).select("industry", F.col("n").alias("k")))


def _bits(g: Graph, rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name0, name1, ...): each key's set of industries as bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("k", F.lit(64)).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("k") / 64) == w, bit)), F.lit(0).cast("long")).alias(f"{name}{w}") for w in range(_words(g))]
    return rows.join(_numbers(g), "industry").groupBy(key).agg(*words)


def _common(g: Graph, a: str, b: str):
    """Number of industries in both of two sets of bits; null where either is."""
    parts = [F.bit_count(F.col(f"{a}{w}").bitwiseAND(F.col(f"{b}{w}"))) for w in range(_words(g))]
    return sum(parts[1:], parts[0])


def _tender_side(g: Graph) -> DataFrame:
    """Everything that scores depend on by the tender alone: facts, buyer and its place and size, industries, edges."""

    def make():
        buyers = g.nodes("organization", "company").select(F.col("uid").alias("buyer"), F.lower(F.coalesce(F.col("attributes")["city"], F.lit(""))).alias("b_city"), F.lower(F.coalesce(F.col("attributes")["province"], F.lit(""))).alias("b_prov"))
        size = g.issued.groupBy("buyer").agg(F.count("*").alias("b_tenders"))
        edges = g.participation.groupBy("tender").agg(F.count("*").alias("n_comp"))
        inds = _bits(g, taking_part(g).join(g.industries, "company"), "tender", "inds")
        out = g.facts.select("tender", "tender_name", "value", "date", "deadline", "city", "province", X.opportunity_bucket("value").alias("bucket")).join(g.buyer_of, "tender", "left")
        return out.join(inds, "tender", "left").join(edges, "tender", "left").join(buyers, "buyer", "left").join(size, "buyer", "left")

    return g.once("tender_side", make)


def _company_side(g: Graph) -> DataFrame:
    """Everything that scores depend on by the company alone: bids, wins, recent ones, value bands, places, industries."""

    def make():
        year = int(g.as_of[:4])
        dated = X.year("date").isin(year, year - 1)
        own = g.participation.join(g.facts.select("tender", X.opportunity_bucket("value").alias("bucket"), F.coalesce(dated, F.lit(False)).alias("recent")), "tender")
        bids = own.groupBy("company").agg(
            F.count("*").alias("c_bids"), F.count_if("is_win").alias("c_wins"), F.count_if("recent").alias("c_recent"), *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in _BUCKETS]
        )
        places = g.locations.join(g.entities.select(F.col("uid").alias("location"), F.lower("name").alias("place")), "location").groupBy("company").agg(F.collect_set("place").alias("places"))
        out = bids.join(places, "company", "full_outer")
        return out.join(_bits(g, g.industries, "company", "mine"), "company", "full_outer")

    return g.once("company_side", make)


def _with_buyer(g: Graph) -> DataFrame:
    """(company, buyer, cb_bids, cb_wins); nearly as many as edges, so it is worked out where it is joined and not stored."""
    return g.participation.join(g.issued, "tender").groupBy("company", "buyer").agg(F.count("*").alias("cb_bids"), F.count_if("is_win").alias("cb_wins"))


def _industry_tenders(g: Graph) -> DataFrame:
    """(company, t_inds.., bids, wins): a company's edges by the industries of their tenders."""
    keys = [f"inds{w}" for w in range(_words(g))]
    theirs = _tender_side(g).filter(F.col("inds0").isNotNull()).select("tender", *[F.col(k).alias(f"t_{k}") for k in keys])
    return g.once("industry_tenders", lambda: g.participation.join(theirs, "tender", "left").groupBy("company", *[f"t_{k}" for k in keys]).agg(F.count("*").alias("bids"), F.count_if("is_win").alias("wins")))


def _industry_history(g: Graph, wanted: DataFrame) -> DataFrame:
    """(company, inds.., rel_bids, rel_wins) for distinct ``wanted`` (company, inds..): the company's own tenders that share an industry
    with inds, bit by bit."""
    keys = [f"inds{w}" for w in range(_words(g))]
    meets = [F.col(k).bitwiseAND(F.col(f"t_{k}")) != 0 for k in keys]
    overlap = meets[0]
    for m in meets[1:]:
        overlap = overlap | m
    sets = _industry_tenders(g).filter("t_inds0 is not null").withColumnRenamed("company", "c")
    rest = wanted.join(sets, (F.col("company") == F.col("c")) & overlap)
    return rest.groupBy("company", *keys).agg(F.sum("bids").alias("rel_bids"), F.sum("wins").alias("rel_wins"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= store.BROADCAST_ROWS else df


def features(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """``pairs``, or all companies with all open tenders, with everything that scores depend on.

    What hangs on the tender or the company alone is worked out once for each. Pairs are joined with their tenders, then
    with the history with the buyer, and last with companies, which are broadcast while they are few, so that pairs are
    shuffled by tender and by buyer alone. A company's tenders all have the company's own industries: where the tender has
    one of them, all its tenders count as history in the tender's industries, and only the other pairs look theirs up."""
    keys, own = [f"inds{w}" for w in range(_words(g))], pairs is not None and pairs is g._made.get("taking_part")
    t, c = _tender_side(g), _company_side(g)
    total = g.participation.groupBy("company").agg(F.count("*").alias("all_bids"), F.count_if("is_win").alias("all_wins"))
    c = stored(c.join(total, "company", "left"), "companies")
    n = c.count()
    mine = c.select("company", *[f"mine{w}" for w in range(_words(g))])
    sets = t.select("tender", *keys).filter("inds0 is not null")
    if pairs is None:
        companies = g.names("company").select(F.col("uid").alias("company"))
        t = t.join(open_tenders(g), "tender", "left_semi")
        out = companies.crossJoin(t)
        wanted = companies.crossJoin(sets.join(open_tenders(g), "tender", "left_semi").select(*keys).distinct()).join(_small(mine, n), "company", "left")
    else:
        out = pairs.join(t, "tender")
        # a tender that the company takes part in has the company's industries, if it has any
        some = mine.filter("mine0 is null") if own else mine
        wanted = (pairs.join(_small(some, n), "company", "inner" if own else "left")).join(sets, "tender")
    shares = F.coalesce(_common(g, "inds", "mine") > 0, F.lit(False))
    out = out.join(_with_buyer(g), ["company", "buyer"], "left").join(_small(c, n), "company", "left")
    wanted = stored(wanted.filter(~shares).select("company", *keys).distinct(), "wanted")
    n_wanted = wanted.count()
    if not n_wanted:
        return out.withColumn("rel_bids", F.when(shares, F.col("all_bids"))).withColumn("rel_wins", F.when(shares, F.col("all_wins")))
    far = _industry_history(g, wanted).select("company", *keys, F.col("rel_bids").alias("far_bids"), F.col("rel_wins").alias("far_wins"))
    out = out.join(_small(far, n_wanted), ["company", *keys], "left")
    return out.withColumn("rel_bids", F.when(shares, F.col("all_bids")).otherwise(F.col("far_bids"))).withColumn("rel_wins", F.when(shares, F.col("all_wins")).otherwise(F.col("far_wins")))


def _clamp(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _competition(comp):
    return F.when(comp == 0, 0.5).when(comp <= 2, 0.9).when(comp <= 5, 0.7).when(comp <= 10, 0.4).otherwise(F.greatest(F.lit(0.1), 1 - comp / 20.0))


def _attractiveness(has_buyer, size):
    return F.when(~has_buyer, 0.3).when(size == 0, 0.2).when(size <= 2, 0.4).when(size <= 10, 0.6).when(size <= 30, 0.8).otherwise(0.95)


def _workload(recent):
    return F.when(recent == 0, 0.9).when(recent <= 3, 0.8).when(recent <= 8, 0.6).when(recent <= 15, 0.4).otherwise(F.greatest(F.lit(0.1), 1 - recent / 30.0))


def _matches(sizes: list) -> list:
    """Of each value band, tenders in it and half of those in its neighbours."""
    return [s + sum([sizes[k] * 0.5 for k in (i - 1, i + 1) if 0 <= k < len(sizes)], F.lit(0.0)) for i, s in enumerate(sizes)]


def _places_of_tender(has_buyer):
    city, prov = (F.when(F.col(a) != "", F.col(a)).when(has_buyer, F.col(b)).otherwise("") for a, b in (("city", "b_city"), ("province", "b_prov")))
    return F.coalesce(city, F.lit("")), F.coalesce(prov, F.lit(""))


def _may_lead(g: Graph, limit: int) -> DataFrame:
    """Pairs of companies with open tenders among which each company's ``limit`` best are: those of a buyer that it has a history
    with, and of all others those that bounds of the score leave."""
    words, n = range(_words(g)), lambda c: F.coalesce(c, F.lit(0))
    _tender_side(g), _company_side(g)
    t = _tender_side(g).join(open_tenders(g), "tender", "left_semi")
    known = stored(_with_buyer(g).select("company", "buyer").join(t.select("tender", "buyer"), "buyer").select("company", "tender"), "known")
    has_buyer = F.col("buyer").isNotNull()
    city, prov = _places_of_tender(has_buyer)
    band = n(F.array_position(F.array(*map(F.lit, _BUCKETS)), F.col("bucket"))) - 1
    points = _competition(n("n_comp")) * WEIGHTS["competition"] + _attractiveness(has_buyer, n("b_tenders")) * WEIGHTS["buyer_attractiveness"] + 0.3 * WEIGHTS["buyer_history"]
    tenders = t.select("tender", points.alias("t_points"), band.alias("band"), city.alias("city"), prov.alias("prov"), has_buyer.alias("has_buyer"), *[f"inds{w}" for w in words])
    sets = F.struct(*[f"t_inds{w}" for w in words], "bids", "wins")
    history = _industry_tenders(g).groupBy("company").agg(
        F.collect_list(F.when(F.col("t_inds0").isNotNull(), sets)).alias("sets"), (F.sum("wins") / F.sum("bids")).alias("rel_points")
    )
    sizes = [n(f"n_{b}") for b in _BUCKETS]
    total = sum(sizes[1:], sizes[0])
    match = F.array(*[F.when(total == 0, 0.5).otherwise(_clamp(m / total)) for m in _matches(sizes)])
    own = _workload(n("c_recent")) * WEIGHTS["workload"] + F.when(n("c_bids") == 0, 0.2).otherwise(_clamp(F.col("c_wins") / F.col("c_bids"))) * WEIGHTS["win_probability"]
    c = g.names("company").select(F.col("uid").alias("company")).join(_company_side(g), "company", "left").join(history, "company", "left")
    c = c.select("company", own.alias("c_points"), match.alias("match"), "places", *[f"mine{w}" for w in words], F.coalesce("rel_points", F.lit(0.3)).alias("rel_points"), "sets")
    return _best.candidates(g, c, tenders, known, len(words), limit).unionByName(known.join(c.select("company"), "company", "left_semi")).distinct()


def score(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """``pairs``, or all companies with all open tenders, with each dimension from 0 to 1, and ``score``."""
    out = features(g, pairs)
    n_inds = _common(g, "inds", "inds")
    n = lambda c: F.coalesce(c, F.lit(0))
    zero = F.lit(0)
    sizes = [n(f"n_{b}") for b in _BUCKETS]
    total = sum(sizes[1:], sizes[0])
    match = F.lit(None).cast("double")
    for b, m in zip(_BUCKETS, _matches(sizes)):
        match = F.when(F.col("bucket") == b, m).otherwise(match)
    has_buyer = F.col("buyer").isNotNull()
    city, prov = _places_of_tender(has_buyer)
    inside = lambda x: F.coalesce((x != "") & F.array_contains("places", x), F.lit(False))
    base = F.col("c_wins") / F.col("c_bids")
    with_buyer = F.col("cb_wins") / F.col("cb_bids")
    comp, size, recent = n("n_comp"), n("b_tenders"), n("c_recent")
    new = F.when(F.col("mine0").isNull(), n_inds).otherwise(n_inds - _common(g, "inds", "mine"))
    dims = {
        "capability": F.when(F.col("mine0").isNull() | F.col("inds0").isNull(), 0.5).otherwise(_common(g, "inds", "mine") / n_inds),
        "buyer_history": F.when(~has_buyer | (n("cb_bids") == 0), 0.3).otherwise(_clamp(with_buyer + _clamp(F.col("cb_bids") / 10.0) * 0.1)),
        "industry_history": F.when(F.col("inds0").isNull(), 0.4).when(n("rel_bids") == 0, 0.3).otherwise(_clamp(F.col("rel_wins") / F.col("rel_bids"))),
        "value_fit": F.when(F.col("value").isNull() | (total == 0), 0.5).otherwise(_clamp(match / total)),
        "geo_fit": F.when(F.col("places").isNull() | ((city == "") & (prov == "")), 0.5).when(inside(city), 1.0).when(inside(prov), 0.7).otherwise(0.2),
        "competition": _competition(comp),
        "buyer_attractiveness": _attractiveness(has_buyer, size),
        "strategic": F.least(F.lit(1.0), 0.3 + F.when(~has_buyer, 0.0).when(n("cb_bids") == 0, 0.3).otherwise(0.1) + 0.15 * F.when(F.col("inds0").isNull(), zero).otherwise(new)),
        "workload": _workload(recent),
        "win_probability": F.when(n("c_bids") == 0, 0.2).when(n("cb_bids") > 0, _clamp((base + with_buyer) / 2)).otherwise(_clamp(base)),
    }
    out = out.withColumns({k: X.rounded(v, 4) for k, v in dims.items()})
    points = [F.col(k) * w for k, w in WEIGHTS.items()]
    return out.withColumn("score", X.rounded(sum(points[1:], points[0]), 1))


def label(score_="score", strategic="strategic"):
    s = F.col(score_)
    return F.when(s >= 75, "Strong Pursue").when(s >= 55, "Pursue").when((s >= 40) & (F.col(strategic) >= 0.6), "Strategic Investment").when(s >= 35, "Monitor").otherwise("Ignore")


def _list(*items):
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, t) for c, t in items]))


def recommendation(g: Graph, pairs: DataFrame) -> DataFrame:
    """(company, tender, score, recommendation, why_pursue, why_ignore, next_actions)."""
    out = score(g, pairs).withColumn("recommendation", label())
    # The limits. The reasons are codes of our own.
    pursue = _list(
        (F.col("capability") >= 0.6, "capability_fits"), (F.col("buyer_history") >= 0.5, "buyer_won_before"),
        (F.col("competition") >= 0.7, "few_rivals"), (F.col("strategic") >= 0.6, "strategic_gain"),
    )
    ignore = _list(
        (F.col("capability") < 0.6, "capability_short"), (F.col("buyer_history") < 0.25, "buyer_unproven"),
        (F.col("competition") < 0.4, "many_rivals"), (F.col("workload") < 0.4, "busy"),
    )
    going = F.col("recommendation").isin("Strong Pursue", "Pursue")
    months = X.months_until("deadline", g.as_of)
    actions = _list(
        (going & (months <= 1), "due_within_a_month"), (going, "staff_the_bid"), (going, "call_the_buyer"),
        (F.col("recommendation") == "Strategic Investment", "look_for_a_partner"), (F.col("recommendation") == "Monitor", "keep_watching"),
    )
    return out.select("company", "tender", "score", "recommendation", pursue.alias("why_pursue"), ignore.alias("why_ignore"), actions.alias("next_actions"))


def explain(g: Graph, pairs: DataFrame) -> DataFrame:
    """Score, label, every dimension's points and the tender's facts, with what was missing or assumed."""
    return score(g, pairs).select(*_explained())


def _explained() -> list:
    missing = _list((F.col("buyer").isNull(), "buyer"), (F.col("value").isNull(), "value"))
    weak = _list((F.col("inds0").isNull(), "tender_industries"), (F.col("geo_fit") == 0.5, "location"))
    assumed = _list((F.coalesce("cb_wins", F.lit(0)) == 0, "no_win_with_buyer"), (F.coalesce("c_bids", F.lit(0)) == 0, "no_bids"))
    points = [X.rounded(F.col(k) * w, 1).alias(f"{k}_points") for k, w in WEIGHTS.items()]
    return ["company", "tender", "tender_name", F.col("value").alias("tender_value"), F.col("date").alias("tender_date"), F.col("deadline").alias("tender_deadline"), "buyer", "score", label().alias("recommendation"), *points, missing.alias("missing_information"), weak.alias("weak_evidence"), assumed.alias("assumptions")]


def _urgency(months):
    return F.when(months.isNull(), "unknown").when(months <= 0, "expired").when(months <= 0.5, "critical").when(months <= 1, "high").when(months <= 3, "medium").otherwise("low")


def _deadline_risk(urgency):
    return F.when(urgency.isin("critical", "expired"), "high").when(urgency == "high", "medium").otherwise("low")


def timeline(g: Graph, pairs: DataFrame) -> DataFrame:
    """(company, tender, value_bucket, months_until_deadline, months_since_issue, submission_urgency, preparation_effort, deadline_risk)."""
    return pairs.join(g.facts, "tender").select(*_timed(g))


def _timed(g: Graph) -> list:
    effort = {"micro": "1-3 days", "small": "3-7 days", "medium": "1-3 weeks", "large": "2-6 weeks", "mega": "2-4 months"}
    b, months = X.opportunity_bucket("value"), X.months_until("deadline", g.as_of)
    text = F
    for k, v in effort.items():
        text = text.when(b == k, v)
    return ["company", "tender", b.alias("value_bucket"), months.alias("months_until_deadline"), X.rounded(-X.months_until("date", g.as_of), 1).alias("months_since_issue"), _urgency(months).alias("submission_urgency"), text.otherwise("unknown").alias("preparation_effort"), _deadline_risk(_urgency(months)).alias("deadline_risk")]


def risk(g: Graph, pairs: DataFrame) -> DataFrame:
    """(company, tender, score, overall_risk, risk_factors, mitigations): seven rules; overall is the worst severity."""
    return score(g, pairs).select(*_risks(g))


def _risks(g: Graph) -> list:
    tight = _deadline_risk(_urgency(X.months_until("deadline", g.as_of))) == "high"
    # Factors, severities and limits. The measures against them are codes of our own.
    rules = [
        ("high_competition", "high", F.col("competition") < 0.4, "share_the_bid"),
        ("capability_gap", "high", F.col("capability") < 0.3, "add_skills"),
        ("partial_capability", "medium", (F.col("capability") >= 0.3) & (F.col("capability") < 0.5), None),
        ("high_workload", "medium", F.col("workload") < 0.4, "free_staff"),
        ("no_buyer_history", "medium", F.col("buyer_history") < 0.25, "meet_the_buyer"),
        ("value_mismatch", "medium", F.col("value_fit") < 0.3, "secure_funds"),
        ("geographic_stretch", "low", F.col("geo_fit") < 0.4, "find_local_help"),
        ("tight_deadline", "high", tight, "begin_now"),
    ]
    any_ = lambda level: F.coalesce(F.greatest(*[c.cast("int") for _, s, c, _ in rules if s == level], F.lit(0)), F.lit(0)) > 0
    overall = F.when(any_("high"), "high").when(any_("medium"), "medium").otherwise("low")
    return ["company", "tender", "score", overall.alias("overall_risk"), _list(*[(c, n) for n, _, c, _ in rules]).alias("risk_factors"), _list(*[(c, m) for *_, c, m in rules if m]).alias("mitigations")]


def portfolio_impact(g: Graph, pairs: DataFrame) -> DataFrame:
    """(company, tender, tender_value, win_probability, expected_revenue, diversification_impact, strategic_value, is_new_client,
    client_expansion_value, future_relationship_potential)."""
    return score(g, pairs).select(*_in_portfolio())


def _in_portfolio() -> list:
    new = F.col("buyer").isNotNull() & (F.coalesce("cb_bids", F.lit(0)) == 0)
    return [
        "company", "tender", F.col("value").alias("tender_value"), "win_probability", X.rounded(F.when(F.col("value") != 0, F.col("value") * F.col("win_probability")), 2).alias("expected_revenue"),
        F.when(F.col("buyer_history") < 0.3, "high").when(F.col("buyer_history") < 0.6, "medium").otherwise("low").alias("diversification_impact"),
        X.bands("strategic", (0.6, "high"), (0.4, "medium"), otherwise="low").alias("strategic_value"), new.alias("is_new_client"), F.when(new, "high").otherwise("low").alias("client_expansion_value"),
        X.bands(F.coalesce("b_tenders", F.lit(0)), (10, "high"), (3, "medium"), otherwise="low").alias("future_relationship_potential"),
    ]


def similar_opportunities(g: Graph, pairs: DataFrame, limit: int | None = 10) -> DataFrame:
    """(company, tender, similar_tender, outcome, similarity, same_buyer, shared_industries, same_bucket): the company's other tenders by
    half a point for the same buyer, 0.3 for a shared industry and 0.2 for the same value band."""
    facts = g.facts.select("tender", X.opportunity_bucket("value").alias("bucket")).join(g.buyer_of, "tender", "left").join(tender_industries(g), "tender", "left")
    mine = g.participation.select("company", F.col("tender").alias("similar_tender"), "is_win").join(facts.select(F.col("tender").alias("similar_tender"), F.col("bucket").alias("b2"), F.col("buyer").alias("y2"), F.col("inds").alias("i2")), "similar_tender")
    both = pairs.join(facts, "tender").join(mine, "company").filter("tender <> similar_tender")
    same, band = F.coalesce(F.col("buyer") == F.col("y2"), F.lit(False)), F.coalesce(F.col("bucket") == F.col("b2"), F.lit(False))
    shared = F.coalesce(F.size(F.array_intersect("inds", "i2")), F.lit(0))
    s = X.rounded(F.when(same, 0.5).otherwise(0.0) + F.when(shared > 0, 0.3).otherwise(0.0) + F.when(band, 0.2).otherwise(0.0), 2)
    out = both.select("company", "tender", "similar_tender", F.when(F.col("is_win"), "win").otherwise("loss").alias("outcome"), s.alias("similarity"), same.alias("same_buyer"), shared.alias("shared_industries"), band.alias("same_bucket")).filter("similarity > 0")
    if limit is None:
        return out
    w = Window.partitionBy("company", "tender").orderBy(F.desc("similarity"), "similar_tender", "outcome")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def best_opportunities(g: Graph, pairs: DataFrame | None = None, limit: int | None = 10) -> DataFrame:
    """(company, tender, score, recommendation, value, buyer, rank): each company's tenders of highest score."""
    if pairs is None and limit is not None:
        pairs = stored(_may_lead(g, limit), "leading")
    out = score(g, pairs).withColumn("recommendation", label())
    w = Window.partitionBy("company").orderBy(F.desc("score"), "tender")
    out = out.select("company", "tender", "score", "recommendation", "value", "buyer", F.row_number().over(w).alias("rank"))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def executive_summary(g: Graph, pairs: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """(company, scored, pursue, ignore, top_tender, top_score, opportunity_cost): of each company's best ``2 limit`` tenders, how many to pursue
    or ignore, and the value of those to pursue beyond the first ``limit``."""
    best = best_opportunities(g, pairs, 2 * limit)
    going = F.col("recommendation").isin("Strong Pursue", "Pursue")
    w = Window.partitionBy("company").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    best = best.withColumn("taken", F.sum(going.cast("int")).over(w))
    return best.groupBy("company").agg(
        F.count("*").alias("scored"), F.least(F.count_if(going), F.lit(limit)).alias("pursue"), F.count_if(F.col("recommendation") == "Ignore").alias("ignore"),
        F.min_by("tender", "rank").alias("top_tender"), F.max("score").alias("top_score"), F.coalesce(X.rounded(F.sum(F.when(going & (F.col("taken") > limit), F.col("value"))), 2), F.lit(0.0)).alias("opportunity_cost"),
    )


def profile(g: Graph, pairs: DataFrame) -> DataFrame:
    """Explanation, timeline, risk and portfolio of each pair as structs, from one score."""
    sections = {"explain": _explained(), "timeline": _timed(g), "risk": _risks(g), "portfolio": _in_portfolio()}
    return score(g, pairs).select("company", "tender", *[F.struct(*columns).alias(name) for name, columns in sections.items()])
