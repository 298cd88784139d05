"""Buyer analytics: who an organisation buys from, when, for how much, and what it will issue next.

Each function returns a row for each buyer (or buyer and supplier, month, bucket, year), for all buyers at once; a
profile of one is a filter on ``uid``. Ties in rankings go to the smaller uid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..plans import schema
from .views import Graph


def _buyers(g: Graph) -> DataFrame:
    return g.names("organization", "company").withColumnRenamed("uid", "buyer")


def _issued(g: Graph) -> DataFrame:
    """Each tender of each buyer with its facts."""
    return g.issued.join(g.facts.select("tender", "issue_value", "issue_year", "issue_month"), "tender")


def _totals(g: Graph) -> DataFrame:
    return g.issued.groupBy("buyer").agg(F.count("*").alias("total_tenders"))


def awards(g: Graph) -> DataFrame:
    """(buyer, supplier, award_count): tenders of a buyer won by a supplier."""
    return g.issued.join(g.winner_of, "tender").groupBy("buyer", F.col("winner").alias("supplier")).agg(F.count("*").alias("award_count"))


def _concentration(g: Graph) -> DataFrame:
    """(buyer, total_awards, unique_suppliers, hhi)."""
    return awards(g).groupBy("buyer").agg(F.sum("award_count").alias("total_awards"), F.count("*").alias("unique_suppliers"), X.hhi("award_count").alias("hhi"))


def _bidders(g: Graph) -> DataFrame:
    """(buyer, tender, bidders): edges by which companies take part, 0 kept."""
    n = g.participation.groupBy("tender").agg(F.count("*").alias("bidders"))
    return g.issued.join(n, "tender", "left").select("buyer", "tender", F.coalesce("bidders", F.lit(0)).alias("bidders"))


def summary(g: Graph) -> DataFrame:
    """(uid, total_tenders, active_suppliers, award_hhi, top_supplier, top_supplier_awards, confidence)."""
    top = awards(g).groupBy("buyer").agg(F.count("*").alias("active_suppliers"), X.hhi("award_count").alias("award_hhi"), F.min(F.struct((-F.col("award_count")).alias("n"), "supplier")).alias("top"))
    out = _buyers(g).join(_totals(g), "buyer").join(top, "buyer", "left")
    return out.select(
        F.col("buyer").alias("uid"), "name", "total_tenders", F.coalesce("active_suppliers", F.lit(0)).alias("active_suppliers"), F.coalesce("award_hhi", F.lit(0.0)).alias("award_hhi"),
        F.col("top.supplier").alias("top_supplier"), (-F.col("top.n")).alias("top_supplier_awards"), X.confidence("total_tenders").alias("confidence"),
    )


def supplier_roster(g: Graph) -> DataFrame:
    """(uid, supplier, award_count, bid_count, win_rate, confidence): every supplier on a buyer's tenders, edges counted."""
    both = g.issued.join(g.participation, "tender").groupBy(F.col("buyer").alias("uid"), F.col("company").alias("supplier"))
    both = both.agg(F.count_if("is_win").alias("award_count"), F.count("*").alias("bid_count"))
    return both.withColumns({"win_rate": X.ratio("award_count", "bid_count"), "confidence": X.confidence("award_count")})


def preferred_suppliers(g: Graph, min_awards: int = 2) -> DataFrame:
    """The roster's suppliers with at least ``min_awards`` awards."""
    return supplier_roster(g).filter(F.col("award_count") >= min_awards)


def supplier_loyalty(g: Graph) -> DataFrame:
    """(uid, supplier, award_count, loyalty_index, overall_loyalty_score, loyalty_interpretation)."""
    w = Window.partitionBy("buyer")
    out = awards(g).join(_totals(g), "buyer").withColumn("h", _hhi_over(w))
    out = out.withColumn("overall_loyalty_score", X.rounded(F.sqrt("h"), 4))
    level = X.bands("overall_loyalty_score", (0.5, "high"), (0.25, "medium"), otherwise="low")
    return out.select(F.col("buyer").alias("uid"), "supplier", "award_count", X.ratio("award_count", "total_tenders").alias("loyalty_index"), "overall_loyalty_score", level.alias("loyalty_interpretation"), X.confidence("award_count").alias("confidence"))


def _hhi_over(w):
    c = F.col("award_count").cast("double")
    return X.rounded(F.sum(c * c).over(w) / F.pow(F.sum(c).over(w), F.lit(2.0)), 4)


def supplier_diversity(g: Graph) -> DataFrame:
    """(uid, total_awards, unique_suppliers, award_hhi, diversity_score, diversity_level); a buyer without awards has diversity 1."""
    out = _totals(g).join(_concentration(g), "buyer", "left")
    out = out.withColumn("award_hhi", F.coalesce("hhi", F.lit(0.0))).withColumn("diversity_score", X.rounded(1 - F.col("award_hhi"), 4))
    level = X.bands("diversity_score", (0.75, "high"), (0.5, "medium"), (0.25, "low"), otherwise="very_low")
    return out.select(F.col("buyer").alias("uid"), F.coalesce("total_awards", F.lit(0)).alias("total_awards"), F.coalesce("unique_suppliers", F.lit(0)).alias("unique_suppliers"), "award_hhi", "diversity_score", level.alias("diversity_level"))


def _mode(df: DataFrame, key: str, name: str) -> DataFrame:
    """(buyer, name): the most frequent value, the smallest of equals."""
    n = df.filter(F.col(key).isNotNull()).groupBy("buyer", key).agg(F.count("*").alias("n"))
    return n.groupBy("buyer").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(key).alias("v"))).alias("m")).select("buyer", F.col("m.v").alias(name))


def buying_patterns(g: Graph) -> DataFrame:
    """(uid, total_tenders, avg_value, avg_bidder_count, peak_month, peak_month_name, busiest_year, cadence_months, year_span, first_year, last_year)."""
    issued = _issued(g)
    base = issued.groupBy("buyer").agg(
        F.count("*").alias("total_tenders"), X.rounded(F.avg("issue_value"), 2).alias("avg_value"), F.count("issue_year").alias("dated"),
        F.min("issue_year").alias("first_year"), F.max("issue_year").alias("last_year"),
    )
    bidders = _bidders(g).groupBy("buyer").agg(X.rounded(F.avg("bidders"), 2).alias("avg_bidder_count"))
    out = base.join(bidders, "buyer").join(_mode(issued, "issue_month", "peak_month"), "buyer", "left").join(_mode(issued, "issue_year", "busiest_year"), "buyer", "left")
    span = F.col("last_year") - F.col("first_year")
    names = F.array(*[F.lit(m) for m in schema.MONTHS])
    return out.select(
        F.col("buyer").alias("uid"), "total_tenders", "avg_value", "avg_bidder_count", "peak_month", F.get(names, F.col("peak_month") - 1).alias("peak_month_name"), "busiest_year",
        F.when((F.col("dated") >= 2) & (span > 0), X.rounded(span * 12 / (F.col("total_tenders") - 1), 1)).alias("cadence_months"), span.alias("year_span"), "first_year", "last_year",
    )


def procurement_seasonality(g: Graph) -> DataFrame:
    """(uid, month, month_name, count, share, seasonality_index, quarter, quarter_count, quarter_share, is_peak_month): twelve rows a buyer."""
    found = _issued(g).groupBy("buyer").agg(*[F.count_if(F.col("issue_month") == m).alias(f"m{m}") for m in range(1, 13)])
    names = F.array(*[F.lit(m) for m in schema.MONTHS])
    counts = F.array(*[F.col(f"m{m}") for m in range(1, 13)])
    rows = found.select("buyer", counts.alias("counts"), F.posexplode(counts).alias("k", "count")).withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    quarter = F.floor(F.col("k") / 3).cast("int")
    q_count = F.aggregate(F.slice("counts", quarter * 3 + 1, 3), F.lit(0).cast("long"), lambda a, x: a + x)
    uniform = F.col("total") / 12
    return rows.select(
        F.col("buyer").alias("uid"), (F.col("k") + 1).alias("month"), F.get(names, F.col("k")).alias("month_name"), "count", X.ratio("count", "total").alias("share"),
        F.coalesce(X.rounded(F.when(uniform != 0, (F.col("count") - uniform) / uniform), 4), F.lit(0.0)).alias("seasonality_index"),
        (quarter + 1).alias("quarter"), q_count.alias("quarter_count"), X.ratio(q_count, "total").alias("quarter_share"),
        (F.col("k") == F.array_position("counts", F.array_max("counts")) - 1).alias("is_peak_month"),
    )


def calendar(g: Graph) -> DataFrame:
    """(uid, year, quarter, month, level, count, share): a buyer's dated tenders rolled up from months to quarters, years and all of
    them, each with its share of the level above; finer columns are null."""
    t = _issued(g).filter("issue_year is not null and issue_month is not null").select(F.col("buyer").alias("uid"), F.col("issue_year").alias("year"), F.ceil(F.col("issue_month") / 3).cast("int").alias("quarter"), F.col("issue_month").alias("month"))
    keys = ["uid", "year", "quarter", "month"]
    n = t.groupingSets([[F.col(k) for k in keys[:i]] for i in range(4, 0, -1)], *keys).agg(F.grouping_id().alias("id"), F.count("*").alias("count"))
    above = [F.max(F.when(F.col("id") == parent, F.col("count"))).over(Window.partitionBy(*keys[:i])) for parent, i in ((1, 3), (3, 2), (7, 1))]
    total = F.when(F.col("id") == 0, above[0]).when(F.col("id") == 1, above[1]).when(F.col("id") == 3, above[2]).otherwise(F.col("count"))
    level = F.when(F.col("id") == 0, "month").when(F.col("id") == 1, "quarter").when(F.col("id") == 3, "year").otherwise("all")
    return n.select(*keys, level.alias("level"), "count", X.ratio("count", total).alias("share"))


def preferred_industries(g: Graph) -> DataFrame:
    """(uid, industry, count, share, confidence): industries of all participants on a buyer's tenders, edges counted."""
    per = g.issued.join(g.participation, "tender").groupBy("buyer", "company").agg(F.count("*").alias("edges"))
    n = per.join(g.industries, "company").groupBy("buyer", "industry").agg(F.sum("edges").alias("count"))
    total = F.sum("count").over(Window.partitionBy("buyer"))
    return n.select(F.col("buyer").alias("uid"), "industry", "count", X.ratio("count", total).alias("share"), X.confidence("count").alias("confidence"))


def preferred_contract_sizes(g: Graph) -> DataFrame:
    """(uid, bucket, count, share, is_preferred, tenders_with_value, avg_value, min_value, max_value): five rows a buyer.

    Negative values count in the average and the least value but in no bucket."""
    names = [b for b, _ in X.BUYER_BUCKETS]
    bucket = X.buyer_bucket("issue_value")
    found = _issued(g).groupBy("buyer").agg(
        *[F.count_if(bucket == b).alias(b) for b in names],
        X.rounded(F.avg("issue_value"), 2).alias("avg_value"), F.min("issue_value").alias("min_value"), F.max("issue_value").alias("max_value"),
    )
    counts = F.array(*[F.col(b) for b in names])
    rows = found.withColumn("counts", counts).withColumn("tenders_with_value", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.select("*", F.posexplode("counts").alias("k", "count"))
    return rows.select(
        F.col("buyer").alias("uid"), F.get(F.array(*[F.lit(b) for b in names]), F.col("k")).alias("bucket"), "count", X.ratio("count", "tenders_with_value").alias("share"),
        (F.col("k") == F.array_position("counts", F.array_max("counts")) - 1).alias("is_preferred"), "tenders_with_value", "avg_value", "min_value", "max_value",
    )


def avg_procurement_value(g: Graph) -> DataFrame:
    """(uid, tenders_with_value, avg_value, median_value, min_value, max_value, total_value)."""
    v = F.col("issue_value")
    return _issued(g).groupBy(F.col("buyer").alias("uid")).agg(
        F.count(v).alias("tenders_with_value"), X.rounded(F.avg(v), 2).alias("avg_value"), X.rounded(F.median(v), 2).alias("median_value"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), X.rounded(F.sum(v), 2).alias("total_value"),
    )


def avg_bidder_count(g: Graph) -> DataFrame:
    """(uid, total_tenders, avg_bidder_count, min_bidder_count, max_bidder_count, single_bidder_tenders, single_bidder_rate)."""
    b = F.col("bidders")
    out = _bidders(g).groupBy(F.col("buyer").alias("uid")).agg(
        F.count("*").alias("total_tenders"), X.rounded(F.avg(b), 2).alias("avg_bidder_count"), F.min(b).alias("min_bidder_count"), F.max(b).alias("max_bidder_count"), F.count_if(b <= 1).alias("single_bidder_tenders"),
    )
    return out.withColumn("single_bidder_rate", X.ratio("single_bidder_tenders", "total_tenders"))


def award_concentration(g: Graph) -> DataFrame:
    """(uid, total_awards, unique_suppliers, hhi, concentration_level, top_suppliers): the ten suppliers of most awards with their shares."""
    w = Window.partitionBy("buyer").orderBy(F.desc("award_count"), "supplier")
    ranked = awards(g).withColumn("rank", F.row_number().over(w))
    top = F.filter(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "supplier", "award_count")))), lambda x: x.isNotNull())
    out = ranked.groupBy("buyer").agg(F.sum("award_count").alias("total_awards"), F.count("*").alias("unique_suppliers"), X.hhi("award_count").alias("hhi"), top.alias("top"))
    out = out.withColumn("top_suppliers", F.transform("top", lambda x: F.struct(x.supplier.alias("uid"), x.award_count.alias("awards"), X.rounded(x.award_count / F.col("total_awards"), 4).alias("share"))))
    return out.select(F.col("buyer").alias("uid"), "total_awards", "unique_suppliers", "hhi", X.concentration("hhi").alias("concentration_level"), "top_suppliers")


def buyer_competitiveness(g: Graph) -> DataFrame:
    """(uid, competitiveness_score, competitiveness_level, avg_bidder_score, diversity_score, open_tender_score)."""
    out = avg_bidder_count(g).join(supplier_diversity(g).select("uid", "diversity_score"), "uid")
    out = out.withColumn("a", F.least(F.lit(1.0), F.col("avg_bidder_count") / 5.0)).withColumn("o", 1 - F.col("single_bidder_rate"))
    score = X.rounded(0.4 * F.col("a") + 0.3 * F.col("diversity_score") + 0.3 * F.col("o"), 4)
    out = out.withColumn("competitiveness_score", score)
    level = X.bands("competitiveness_score", (0.65, "highly_competitive"), (0.4, "moderately_competitive"), otherwise="low_competition")
    return out.select("uid", "competitiveness_score", level.alias("competitiveness_level"), X.rounded("a", 4).alias("avg_bidder_score"), "diversity_score", X.rounded("o", 4).alias("open_tender_score"))


def buyer_timeline(g: Graph) -> DataFrame:
    """(uid, year, tender_count, unique_suppliers, unique_winners, total_value, avg_value, top_winner, trend): a row for each year with tenders.

    The trend compares a buyer's last year with the one before that has tenders: beyond a fifth more or less is growing or declining."""
    issued = _issued(g).filter("issue_year is not null")
    years = issued.groupBy("buyer", "issue_year").agg(F.count("*").alias("tender_count"), X.rounded(F.sum("issue_value"), 2).alias("total_value"), X.rounded(F.avg("issue_value"), 2).alias("avg_value"))
    per = issued.select("buyer", "issue_year", "tender").join(g.participation, "tender").groupBy("buyer", "issue_year", "company").agg(F.count_if("is_win").alias("wins"))
    people = per.groupBy("buyer", "issue_year").agg(
        F.count("*").alias("unique_suppliers"), F.count_if(F.col("wins") > 0).alias("unique_winners"),
        F.min(F.when(F.col("wins") > 0, F.struct((-F.col("wins")).alias("n"), "company"))).alias("top"),
    )
    w = Window.partitionBy("buyer").orderBy(F.desc("issue_year"))
    last, prior = F.first("tender_count").over(w), F.nth_value("tender_count", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    trend = F.when(prior.isNull(), "insufficient_data").when(last > prior * 1.2, "growing").when(last < prior * 0.8, "declining").otherwise("stable")
    out = years.join(people, ["buyer", "issue_year"], "left").withColumn("trend", trend)
    return out.select(
        F.col("buyer").alias("uid"), F.col("issue_year").alias("year"), "tender_count", F.coalesce("unique_suppliers", F.lit(0)).alias("unique_suppliers"), F.coalesce("unique_winners", F.lit(0)).alias("unique_winners"),
        "total_value", "avg_value", F.col("top.company").alias("top_winner"), "trend",
    )


def tender_forecast(g: Graph, december_late: bool = False) -> DataFrame:
    """(uid, tenders_with_dates, forecast_probability, forecast_basis, cadence_months, last_tender_year, last_tender_month,
    months_since_last, estimated_next_year, estimated_next_month).

    The cadence is the mean of positive gaps between consecutive months with tenders. ``december_late`` puts December
    estimates one year later, as a known defect of the original formula did."""
    today = int(g.as_of[:4]) * 12 + int(g.as_of[5:7])
    ordinal = F.col("issue_year") * 12 + F.col("issue_month")
    dated = _issued(g).select("buyer", F.when(F.col("issue_month") > 0, ordinal).alias("ym"))
    n = dated.groupBy("buyer").agg(F.count("*").alias("total_tenders"), F.count("ym").alias("tenders_with_dates"), F.max("ym").alias("last"), F.min("ym").alias("first"), F.count_distinct("ym").alias("months"))
    # Positive gaps between sorted months add up to last - first, over one fewer than the distinct months.
    n = n.withColumn("cadence_months", F.when(F.col("months") > 1, X.rounded((F.col("last") - F.col("first")) / (F.col("months") - 1), 1)))
    since = F.lit(today) - F.col("last")
    probability = F.when(F.col("cadence_months") > 0, X.rounded(F.least(F.lit(1.0), since / F.col("cadence_months")), 4)).otherwise(0.5)
    next_ = (F.col("last") + F.bround("cadence_months", 0)).cast("int")
    year = (lambda ym: F.floor(ym / 12)) if december_late else (lambda ym: F.floor((ym - 1) / 12))
    return n.select(
        F.col("buyer").alias("uid"), "total_tenders", "tenders_with_dates", probability.alias("forecast_probability"),
        F.when(F.col("tenders_with_dates") == 0, "no_dated_tenders").when(F.col("cadence_months") > 0, "cadence_model").otherwise("base_rate").alias("forecast_basis"),
        "cadence_months", F.floor((F.col("last") - 1) / 12).cast("int").alias("last_tender_year"), (F.pmod(F.col("last") - 1, F.lit(12)) + 1).cast("int").alias("last_tender_month"),
        since.cast("int").alias("months_since_last"), year(next_).cast("int").alias("estimated_next_year"), (F.pmod(next_ - 1, F.lit(12)) + 1).cast("int").alias("estimated_next_month"),
    )


def profile(g: Graph) -> DataFrame:
    """(uid, summary, patterns, value, bidders, concentration, competitiveness, forecast): one struct a sub-report."""
    parts = {"patterns": buying_patterns, "value": avg_procurement_value, "bidders": avg_bidder_count, "diversity": supplier_diversity, "concentration": award_concentration, "competitiveness": buyer_competitiveness, "forecast": tender_forecast}
    out = summary(g).select("uid", F.struct("*").alias("summary"))
    for name, f in parts.items():
        out = out.join(f(g).select("uid", F.struct("*").alias(name)), "uid", "left")
    return out
