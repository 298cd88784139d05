"""Competitive analytics: rivals, market shares, concentration, dominance and pressure, for all companies or scopes at once.

``companies``, where a function takes it, is a DataFrame with a column ``company`` that limits whose rivals are found;
rival pairs are aggregated straight after the join and never kept. Ties in rankings go to the smaller uid. A scope is
a buying organisation, city, province or industry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..session import stored
from . import store
from .pairs import Kind, counted
from .views import Graph


def _top(df: DataFrame, key: str, order: list, limit: int | None) -> DataFrame:
    if limit is None:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")


def _own(g: Graph, companies: DataFrame | None) -> DataFrame:
    p = g.participation
    return p if companies is None else p.join(companies.select("company").distinct(), "company", "left_semi")


def _meetings(g: Graph, companies: DataFrame | None = None) -> DataFrame:
    """(company, rival, tender, role, rival_role): a row for each pair of edges of two companies on one tender."""
    a = _own(g, companies).select("company", "tender", "role")
    b = g.participation.select(F.col("company").alias("rival"), "tender", F.col("role").alias("rival_role"))
    return a.join(b, "tender").filter("company <> rival")


def direct_competitors(g: Graph, companies: DataFrame | None = None, limit: int | None = 50) -> DataFrame:
    """(uid, rival, shared_tenders, shared_buyers, competition_score, confidence): one point a shared tender, half a shared buyer."""
    own, all_ = _own(g, companies), g.participation
    kinds = {
        "shared_tenders": Kind(own.select("company", "tender"), None if companies is None else all_.select("company", "tender")),
        "shared_buyers": Kind(own.join(g.buyer_of, "tender").select("company", "buyer"), all_.join(g.issued, "tender").select("company", "buyer")),
    }
    out = counted(kinds, most=None if limit is None else ({"shared_tenders": 2, "shared_buyers": 1}, limit)).named("uid", "rival")
    out = out.withColumn("competition_score", X.rounded(F.col("shared_tenders") * 1.0 + F.col("shared_buyers") * 0.5, 2))
    return out.select("uid", "rival", "shared_tenders", "shared_buyers", "competition_score", X.confidence(F.col("shared_tenders") + F.col("shared_buyers")).alias("confidence"))


def emerging_competitors(g: Graph, companies: DataFrame | None = None, lookback_years: int = 2, limit: int | None = 30) -> DataFrame:
    """(uid, rival, recent_appearances, older_appearances, is_new_entrant, growth_ratio, confidence): rivals met more often since the cutoff year."""
    recent, older, _ = _by_age(g, _own(g, companies), lookback_years)
    all_ = (None, None) if companies is None else _by_age(g, g.participation, lookback_years)[:2]
    found = counted({"recent_appearances": Kind(recent, all_[0], edges=True), "older_appearances": Kind(older, all_[1], edges=True)})
    ratio = F.col("recent_appearances") / F.greatest("older_appearances", F.lit(1))
    pairs = found.pairs.withColumns({"is_new_entrant": F.col("older_appearances") == 0, "growth_ratio": X.rounded(ratio, 2), "confidence": X.confidence("recent_appearances")})
    pairs = pairs.filter((F.col("recent_appearances") > 0) & (F.col("is_new_entrant") | (ratio > 1)))
    return found._replace(pairs=pairs).top([F.desc("growth_ratio"), "b"], limit).named("uid", "rival")


def _by_age(g: Graph, edges: DataFrame, lookback_years: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(company, tender) of ``edges`` with tenders issued since the cutoff year, before it, and of no known year."""
    cutoff, e, y = int(g.as_of[:4]) - lookback_years, edges.select("company", "tender"), F.col("issue_year")
    dated = e.join(g.facts.select("tender", "issue_year").filter("issue_year is not null"), "tender").select("company", "tender", "issue_year")
    part = lambda c: dated.filter(c).select("company", "tender")
    return part(y >= cutoff), part(y < cutoff), e.join(g.facts.filter("issue_year is not null").select("tender"), "tender", "left_anti").select("company", "tender")


SPARE = 8  # of how many companies rivals are looked for at first, for each one that is counted


def _up_to(g: Graph, kinds: dict[str, Kind], hit: Column, limit: int, left: DataFrame | None = None) -> DataFrame:
    """(company, n): how many others each company has whose counts of ``kinds`` fit ``hit``, ``limit`` at most; of ``left`` (company) alone
    where it is given. Companies without any may have no row.

    A company that has ``limit`` of them among some of the others needs no further look. So the others are looked at in
    parts, by the hash of their uid, each some times as large as the one before; pairs with the others of a part are
    counted in full, and companies that still have fewer meet the next part, which in the end is all of them."""
    share, done = max(1, g.names("company").count() // (SPARE * limit)), None
    while True:
        part = {}
        for name, k in kinds.items():
            first, second = (k.first if left is None else store._some(k.first, left, ["company"])).toDF("company", "key"), k.second.toDF("company", "key")
            if share > 1:
                second = stored(second.filter(F.pmod(F.xxhash64("company"), F.lit(share)) == 0), "some")
                first = store._some(first, stored(second.select("key").distinct(), "keys"), ["key"]).select("company", "key")
            part[name] = Kind(first, second, edges=k.edges)
        found = counted(part)
        n = found.pairs.filter(hit).groupBy("a").agg(F.least(F.count("*"), F.lit(limit).cast("long")).alias("n"))
        n = stored(n.join(found.numbers.select(F.col("n").alias("a"), F.col("uid").alias("company")), "a").select("company", "n"), "up-to")
        if share == 1:
            return n if done is None else done.unionByName(n)
        full = n.filter(F.col("n") >= limit)
        done = full if done is None else done.unionByName(full)
        left = stored((g.participation.select("company").distinct() if left is None else left).join(full.select("company"), "company", "left_anti"), "left")
        if not left.limit(1).count():
            return done
        share = max(1, share // 8)


def rivals_up_to(g: Graph, limit: int) -> DataFrame:
    """(company, rivals): how many companies each meets on tenders, ``limit`` at most; companies that meet none may have no row."""
    on = g.participation.select("company", "tender")
    return _up_to(g, {"n": Kind(on, on)}, F.col("n") > 0, limit).withColumnRenamed("n", "rivals")


def direct_up_to(g: Graph, limit: int, met: DataFrame) -> DataFrame:
    """(company, direct): how many direct competitors (``direct_competitors``) each company has, ``limit`` at most. ``met``: (company, rivals),
    stored, as ``rivals_up_to`` has it for this limit or a larger one: who meets so many has as many direct competitors."""
    enough = met.filter(F.col("rivals") >= limit)
    left = stored(g.participation.select("company").distinct().join(enough, "company", "left_anti"), "left")
    out = enough.select("company", F.lit(limit).cast("long").alias("n"))
    if left.limit(1).count():
        on = g.participation.select("company", "tender")
        kinds = {"tenders": Kind(on, on), "buyers": Kind(g.participation.join(g.buyer_of, "tender").select("company", "buyer"), g.participation.join(g.issued, "tender").select("company", "buyer"))}
        out = out.unionByName(_up_to(g, kinds, F.lit(True), limit, left))
    return out.withColumnRenamed("n", "direct")


def emerging_up_to(g: Graph, limit: int, lookback_years: int = 2) -> DataFrame:
    """(company, emerging): how many emerging competitors (``emerging_competitors``) each company has, ``limit`` at most."""
    recent, older, _ = _by_age(g, g.participation, lookback_years)
    left = stored(recent.select("company").distinct(), "recent")  # all others have none
    kinds = {"recent": Kind(recent, recent, edges=True), "older": Kind(older, older, edges=True)}
    return _up_to(g, kinds, F.col("recent") > F.col("older"), limit, left).withColumnRenamed("n", "emerging")


def co_bidders(g: Graph, companies: DataFrame | None = None, min_count: int = 1, limit: int | None = 50) -> DataFrame:
    """(uid, rival, co_bid_count, confidence): meetings on tenders, edges counted."""
    out = _meetings(g, companies).groupBy(F.col("company").alias("uid"), "rival").agg(F.count("*").alias("co_bid_count")).filter(F.col("co_bid_count") >= min_count)
    return _top(out.withColumn("confidence", X.confidence("co_bid_count")), "uid", [F.desc("co_bid_count"), "rival"], limit)


def common_losers(g: Graph, companies: DataFrame | None = None, limit: int | None = 30) -> DataFrame:
    """(uid, rival, times_lost_to_winner, confidence): rivals without the award on tenders that the company won."""
    lost = _meetings(g, companies).filter("role = 'awarded_to' and rival_role <> 'awarded_to'")
    out = lost.groupBy(F.col("company").alias("uid"), "rival").agg(F.count("*").alias("times_lost_to_winner"))
    return _top(out.withColumn("confidence", X.confidence("times_lost_to_winner")), "uid", [F.desc("times_lost_to_winner"), "rival"], limit)


def buyer_preferences(g: Graph, limit: int | None = 30) -> DataFrame:
    """(buyer, supplier, award_count, bid_count, win_rate, confidence): awards and other edges of each supplier on a buyer's tenders."""
    n = g.issued.join(g.participation, "tender").groupBy("buyer", F.col("company").alias("supplier")).agg(F.count_if("is_win").alias("award_count"), F.count_if(~F.col("is_win")).alias("bid_count"))
    n = n.withColumns({"win_rate": X.ratio("award_count", F.col("award_count") + F.col("bid_count")), "confidence": X.confidence("award_count")})
    return _top(n, "buyer", [F.desc("award_count"), "supplier"], limit)


def market_concentration(g: Graph) -> DataFrame:
    """(scope, total_awards, supplier_count, hhi, concentration_level); a scope without awards has no row."""
    out = g.scope_wins.groupBy("scope").agg(F.sum("wins").alias("total_awards"), F.count("*").alias("supplier_count"), X.hhi("wins").alias("hhi"))
    return out.withColumn("concentration_level", X.concentration("hhi"))


def dominant_suppliers(g: Graph, limit: int | None = 20) -> DataFrame:
    """(scope, supplier, win_count, market_share, confidence): a scope's winners and their share of its awards."""
    total = F.sum("wins").over(Window.partitionBy("scope"))
    out = g.scope_wins.select("scope", F.col("company").alias("supplier"), F.col("wins").alias("win_count"), X.ratio("wins", total).alias("market_share"), X.confidence("wins").alias("confidence"))
    return _top(out, "scope", [F.desc("win_count"), "supplier"], limit)


def market_share(g: Graph, by: str = "company", limit: int | None = 50) -> DataFrame:
    """(scope, label, count, share): a scope's tenders by winner, year, buyer, or the winner's city, province or industry."""
    names = lambda df, key: df.join(g.names("company", "organization", "city", "province", "industry").select(F.col("uid").alias(key), F.col("name").alias("label")), key)
    if by == "company":
        label = names(g.winner_of, "winner")
    elif by == "buyer":
        label = names(g.buyer_of, "buyer")
    elif by == "year":
        label = g.facts.select("tender", F.col("activity_year").cast("string").alias("label")).filter("label is not null")
    else:
        members = {"city": g.cities, "province": g.provinces, "industry": g.industries}[by]
        first = members.groupBy(F.col("company").alias("winner")).agg(F.min(by).alias(by))
        label = names(g.winner_of.join(first, "winner"), by)
    n = g.scopes.join(label.select("tender", "label"), "tender").groupBy("scope", "label").agg(F.count("*").alias("count"))
    out = n.withColumn("share", X.ratio("count", F.sum("count").over(Window.partitionBy("scope"))))
    return _top(out, "scope", [F.desc("count"), "label"], limit)


def all_market_shares(g: Graph) -> DataFrame:
    """(scope, dimension, label, count, share) of buyer scopes: winner, year and the winner's city, province and industry.

    One aggregate over grouping sets has the counts of all dimensions, and as its coarsest set each scope's awards with
    a known label in each of them, which shares are of. Awards without a label in a dimension count in the others."""
    first = lambda members, key: members.groupBy(F.col("company").alias("winner")).agg(F.min(key).alias(key))
    t = g.issued.filter(X.is_kind("buyer", "organization")).join(g.winner_of, "tender").join(g.facts.select("tender", F.col("activity_year").cast("string").alias("year")), "tender")
    for members, key in ((g.cities, "city"), (g.provinces, "province"), (g.industries, "industry")):
        t = t.join(first(members, key), "winner", "left")
    dims = ["winner", "year", "city", "province", "industry"]
    sets = [*[[F.col("scope"), F.col(d)] for d in dims], [F.col("scope")]]
    n = t.select(F.col("buyer").alias("scope"), *dims).groupingSets(sets, "scope", *dims).agg(F.grouping_id().alias("id"), F.count("*").alias("count"), *[F.count(d).alias(f"n_{d}") for d in dims])
    all_ = (1 << len(dims)) - 1  # the id of the set without any dimension
    each = {d: all_ - (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    pick = lambda values: F.coalesce(*[F.when(F.col("id") == each[d], v) for d, v in values.items()])
    totals = {d: F.max(F.when(F.col("id") == all_, F.col(f"n_{d}"))).over(Window.partitionBy("scope")) for d in dims}
    rows = n.select("scope", pick({d: F.lit(d) for d in dims}).alias("dimension"), pick({d: F.col(d) for d in dims}).alias("label"), "count", pick(totals).alias("total"))
    return rows.filter("label is not null").select("scope", "dimension", "label", "count", X.ratio("count", "total").alias("share"))


def challenger_companies(g: Graph, lookback_years: int = 2, limit: int | None = 20) -> DataFrame:
    """(scope, company, recent_wins, older_wins, growth_ratio, recent_share, confidence): recent winners but the three of most older wins.

    Awards without a year count as older."""
    cutoff = int(g.as_of[:4]) - lookback_years
    t = g.scopes.join(g.winner_of, "tender").join(g.facts.select("tender", "issue_year"), "tender")
    recent = F.coalesce(F.col("issue_year") >= cutoff, F.lit(False))
    n = t.groupBy("scope", F.col("winner").alias("company")).agg(F.count_if(recent).alias("recent_wins"), F.count_if(~recent).alias("older_wins"))
    w = Window.partitionBy("scope")
    n = n.withColumn("rank", F.row_number().over(w.orderBy(F.desc("older_wins"), "company"))).withColumn("total", F.sum("recent_wins").over(w))
    incumbent = (F.col("older_wins") > 0) & (F.col("rank") <= 3)
    out = n.filter(~incumbent & (F.col("recent_wins") > 0))
    growth = F.col("recent_wins") / F.greatest("older_wins", F.lit(1))
    out = out.select("scope", "company", "recent_wins", "older_wins", X.rounded(growth, 2).alias("growth_ratio"), X.ratio("recent_wins", "total").alias("recent_share"), X.confidence("recent_wins").alias("confidence"))
    return _top(out, "scope", [F.desc("growth_ratio"), "company"], limit)


def award_stats(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Of each buyer (total_wins, total_value, value_coverage); of each buyer and company (wins, value). Award edges, valued by
    the edge, else the tender."""
    v = F.coalesce(X.money(X.truthy("contract_value")), F.col("award_value"))
    edges = g.participation.filter("is_win").join(g.facts.select("tender", "award_value"), "tender").join(g.issued, "tender").withColumn("v", v)
    own = edges.groupBy("buyer", "company").agg(F.count("*").alias("wins"), F.count("v").alias("valued"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))
    total = own.groupBy("buyer").agg(F.sum("wins").alias("total_wins"), F.sum("value").alias("total_value"), X.rounded(F.sum("valued") / F.sum("wins"), 4).alias("value_coverage"))
    return total, own


def buyer_dominance(g: Graph) -> DataFrame:
    """(uid, buyer, company_wins, total_wins, freq_share, val_share, alpha, dominance): a company's hold on each buyer it won from.

    Dominance mixes shares of value and of count by the part of the buyer's awards whose value is known."""
    total, own = award_stats(g)
    pairs = g.participation.filter("is_win").join(g.buyer_of, "tender").select("company", "buyer").distinct()
    out = pairs.join(own, ["buyer", "company"], "left").join(total, "buyer")
    freq = F.coalesce("wins", F.lit(0)) / F.col("total_wins")
    value = F.when(F.col("total_value") > 0, F.coalesce("value", F.lit(0.0)) / F.col("total_value")).otherwise(0.0)
    a = F.col("value_coverage")
    return out.select(F.col("company").alias("uid"), "buyer", F.coalesce("wins", F.lit(0)).alias("company_wins"), "total_wins", X.rounded(freq, 4).alias("freq_share"), X.rounded(value, 4).alias("val_share"), a.alias("alpha"), (a * value + (1 - a) * freq).alias("dominance"))


def win_rate(g: Graph) -> DataFrame:
    """(uid, wins, win_rate, loss_rate, buyer_count, value_coverage) of each company: mean dominance over its buyers, weighted by their awards.

    A company whose won tenders have no known buyer gets one over the number of companies on them; without wins 0."""
    return g.once("win_rate", lambda: _win_rate(g))


def _win_rate(g: Graph) -> DataFrame:
    won = g.participation.filter("is_win")
    wins = g.participation.groupBy("company").agg(F.count_if("is_win").alias("wins"))
    d = buyer_dominance(g).groupBy(F.col("uid").alias("company")).agg(
        X.rounded(F.sum(F.col("dominance") * F.col("total_wins")) / F.sum("total_wins"), 4).alias("score"), F.count("*").alias("buyer_count"),
        X.rounded(F.sum(F.col("alpha") * F.col("total_wins")) / F.sum("total_wins"), 4).alias("value_coverage"),
    )
    lone = won.select("company", "tender").join(d.select("company"), "company", "left_anti")
    around = lone.join(g.participation.select("tender", F.col("company").alias("other")), "tender").groupBy("company").agg(X.rounded(1 / F.count_distinct("other"), 4).alias("alone"))
    out = g.names("company").select(F.col("uid").alias("company")).join(wins, "company", "left").join(d, "company", "left").join(around, "company", "left")
    score = F.coalesce("score", "alone", F.lit(0.0))
    return out.select(F.col("company").alias("uid"), F.coalesce("wins", F.lit(0)).alias("wins"), score.alias("win_rate"), X.rounded(1 - score, 4).alias("loss_rate"), F.coalesce("buyer_count", F.lit(0)).alias("buyer_count"), F.coalesce("value_coverage", F.lit(0.0)).alias("value_coverage"))


def trend_label(last: Column, prior: Column, margin: float) -> Column:
    return F.when(prior.isNull(), "insufficient_data").when(last > prior * (1 + margin), "growing").when(last < prior * (1 - margin), "declining").otherwise("stable")


def growth_trend(g: Graph) -> DataFrame:
    """(uid, year, wins, bids, total, trend): yearly tender edges; the trend compares the last two years present, ten per cent apart."""
    y = g.participation.join(g.facts.select("tender", F.col("activity_year").alias("year")), "tender").filter("year is not null")
    n = y.groupBy(F.col("company").alias("uid"), "year").agg(F.count_if("is_win").alias("wins"), F.count_if(~F.col("is_win")).alias("bids"), F.count("*").alias("total"))
    w = Window.partitionBy("uid").orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return n.withColumn("trend", trend_label(F.first("total").over(w), F.nth_value("total", 2).over(w), 0.1))


def competitor_rankings(g: Graph, by: str = "wins", limit: int | None = 30) -> DataFrame:
    """(scope, company, wins, bids, total_appearances, win_rate, market_share, confidence) of the companies on a scope's tenders."""
    n = g.scopes.join(g.participation, "tender").groupBy("scope", "company").agg(F.count_if("is_win").alias("wins"), F.count_if(~F.col("is_win")).alias("bids"))
    total = F.col("wins") + F.col("bids")
    won = F.sum("wins").over(Window.partitionBy("scope"))
    n = n.withColumns({"total_appearances": total, "win_rate": X.ratio("wins", total), "market_share": X.ratio("wins", won), "confidence": X.confidence(total)})
    return _top(n, "scope", [F.desc(by), "company"], limit)


def competitive_pressure(g: Graph, met: DataFrame | None = None) -> DataFrame:
    """(uid, competitive_pressure_score, pressure_level, competitor_density, win_pressure, co_bid_intensity, buyer_hhi,
    unique_competitors, total_tender_events).

    Buyer HHI is the mean over the three buyers of smallest uid that the company meets. ``met``: (company, rivals) where known."""
    if met is None:
        found = counted({"n": Kind(g.participation.select("company", "tender"))})
        met = found.pairs.groupBy("a").agg(F.count("*").alias("rivals")).join(found.numbers.select(F.col("n").alias("a"), F.col("uid").alias("company")), "a").select("company", "rivals")
    sized = g.participation.select("company", "tender").withColumn("edges", F.count("*").over(Window.partitionBy("tender")))
    events = stored(sized.groupBy("company").agg(F.count("*").alias("events"), F.avg(F.col("edges") - 1).alias("co")), "events")
    w = Window.partitionBy("company").orderBy("buyer")  # ranks reach below the shuffle
    buyers = g.participation.select("company", "tender").join(g.buyer_of, "tender").select("company", "buyer").withColumn("r", F.dense_rank().over(w)).filter("r <= 3").select("company", "buyer").distinct()
    buyers = stored(buyers, "first-buyers")
    h = market_concentration(g).select(F.col("scope").alias("buyer"), "hhi")
    h = stored(buyers.join(h, "buyer", "left").groupBy("company").agg(F.avg(F.coalesce("hhi", F.lit(0.0))).alias("buyer_hhi")), "hhi")
    out = win_rate(g).select(F.col("uid").alias("company"), "win_rate").join(events, "company", "left").join(met, "company", "left").join(h, "company", "left")
    density = F.least(F.lit(1.0), F.coalesce("rivals", F.lit(0)) / 20.0)
    intensity = F.least(F.lit(1.0), F.coalesce("co", F.lit(0.0)) / 5.0)
    win, hhi = X.rounded(1 - F.col("win_rate"), 4), F.coalesce("buyer_hhi", F.lit(0.0))
    score = X.rounded(0.3 * density + 0.35 * win + 0.2 * intensity + 0.15 * hhi, 4)
    return out.select(
        F.col("company").alias("uid"), score.alias("competitive_pressure_score"), X.bands(score, (0.65, "high"), (0.35, "medium"), otherwise="low").alias("pressure_level"),
        X.rounded(density, 4).alias("competitor_density"), win.alias("win_pressure"), X.rounded(intensity, 4).alias("co_bid_intensity"), X.rounded(hhi, 4).alias("buyer_hhi"),
        F.coalesce("rivals", F.lit(0)).alias("unique_competitors"), F.coalesce("events", F.lit(0)).alias("total_tender_events"),
    )
