"""Executive decisions: the analytics of a company put together into positions, priorities and risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import stored
from . import company, competitive, opportunity, relationship
from .views import Graph


def _trend(g: Graph) -> DataFrame:
    return competitive.growth_trend(g).groupBy("uid").agg(F.first("trend").alias("trend"))


def company_situation(g: Graph) -> DataFrame:
    """(uid, win_rate, bid_count, trend, top_buyer, health_score, confidence): health is the mean of win rate and bids over twenty."""
    top = company.buyers(g).groupBy("uid").agg(F.min(F.struct((-F.col("tender_count")).alias("n"), "buyer")).alias("b"))
    s = company.summary(g).select("uid", (F.col("tenders_won") + F.col("tenders_submitted")).alias("bid_count"), "confidence_score")
    out = competitive.win_rate(g).select("uid", "win_rate").join(s, "uid").join(_trend(g), "uid", "left").join(top, "uid", "left")
    health = (F.col("win_rate") + F.least(F.lit(1.0), F.col("bid_count") / 20.0)) / 2
    return out.select("uid", "win_rate", "bid_count", F.coalesce("trend", F.lit("insufficient_data")).alias("trend"), F.col("b.buyer").alias("top_buyer"), X.rounded(health, 4).alias("health_score"), F.col("confidence_score").alias("confidence"))


def _pressed(g: Graph) -> DataFrame:
    """(uid, pressure_score, pressure_level, win_rate, direct_competitors): pressure grows with up to twenty rivals met, and at most
    five direct competitors are counted."""
    met = competitive.rivals_up_to(g, 20)
    direct = competitive.direct_up_to(g, 5, met).select(F.col("company").alias("uid"), "direct")
    p = competitive.competitive_pressure(g, met).select("uid", F.col("competitive_pressure_score").alias("pressure_score"), "pressure_level", X.rounded(1 - F.col("win_pressure"), 4).alias("win_rate"))
    return p.join(direct, "uid", "left").select(*p.columns, F.coalesce("direct", F.lit(0).cast("long")).alias("direct_competitors"))


def market_position(g: Graph) -> DataFrame:
    """(uid, pressure_score, pressure_level, classification, win_rate, direct_competitors, emerging_threats): at most five
    direct competitors and three emerging ones, as reports show them."""
    kind = X.bands("win_rate", (0.5, "incumbent"), (0.2, "challenger"), otherwise="emerging")
    out = _pressed(g).join(competitive.emerging_up_to(g, 3).withColumnRenamed("company", "uid"), "uid", "left")
    return out.select("uid", "pressure_score", "pressure_level", kind.alias("classification"), "win_rate", "direct_competitors", F.coalesce("emerging", F.lit(0).cast("long")).alias("emerging_threats"))


def relationship_map(g: Graph) -> DataFrame:
    """(uid, partner_count, inferred_count, chain_count): at most ten partners and ten inferred links, as reports show them."""
    partners, inferred = relationship.partner_count(g, 10), relationship.inferred_count(g, 10)
    chains = relationship.subcontractor_chains(g).groupBy("uid").agg(F.count("*").alias("chain_count"))
    out = g.names("company").select("uid").join(partners, "uid", "left").join(inferred, "uid", "left").join(chains, "uid", "left")
    return out.select("uid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("partner_count", "inferred_count", "chain_count")])


def opportunity_pipeline(g: Graph, pairs: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(uid, total_scored, pursue_count, pipeline_health, best_tender): of the ``limit`` best open tenders those of 50 points or more, over all scored."""
    if pairs is None:  # every company meets every open tender: one number
        total = g.names("company").select(F.col("uid").alias("company"), F.lit(opportunity.open_tenders(g).count()).cast("long").alias("total_scored")).filter("total_scored > 0")
    else:
        total = pairs.groupBy("company").agg(F.count("*").alias("total_scored"))
    best = opportunity.best_opportunities(g, pairs, limit).groupBy("company").agg(F.count_if(F.col("score") >= 50).alias("pursue_count"), F.min_by("tender", "rank").alias("best_tender"), F.max("score").alias("best_score"))
    out = total.join(best, "company", "left")
    return out.select(F.col("company").alias("uid"), "total_scored", F.coalesce("pursue_count", F.lit(0)).alias("pursue_count"), X.ratio("pursue_count", "total_scored").alias("pipeline_health"), "best_tender", "best_score")


def buyer_landscape(g: Graph) -> DataFrame:
    """(uid, buyer, tenders_issued): a company's buyers and how much they issue in all."""
    issued = g.issued.groupBy("buyer").agg(F.count("*").alias("tenders_issued"))
    return company.buyers(g).select("uid", "buyer").join(issued, "buyer", "left").select("uid", "buyer", F.coalesce("tenders_issued", F.lit(0)).alias("tenders_issued"))


def strategic_priorities(g: Graph, limit: int = 10) -> DataFrame:
    """(uid, label, subject, score, level): the three best tenders, the two buyers of most tenders, and market presence for emerging companies."""
    best = opportunity.best_opportunities(g, limit=3).select(F.col("company").alias("uid"), F.lit("pursue_opportunity").alias("label"), F.col("tender").alias("subject"), X.rounded(F.col("score") / 100, 4).alias("score"))
    near = competitive._top(company.buyers(g), "uid", [F.desc("tender_count"), "buyer"], 2).select("uid", F.lit("deepen_buyer_relationship").alias("label"), F.col("buyer").alias("subject"), F.lit(0.55).alias("score"))
    new = competitive.win_rate(g).filter("win_rate < 0.2").select("uid", F.lit("build_market_presence").alias("label"), F.lit("").alias("subject"), F.lit(0.65).alias("score"))
    out = best.unionByName(near).unionByName(new)
    level = X.bands("score", (0.75, "critical"), (0.5, "high"), (0.25, "medium"), otherwise="low")
    return competitive._top(out.withColumn("level", level), "uid", [F.desc("score"), "label", "subject"], limit)


def risk_register(g: Graph) -> DataFrame:
    """(uid, overall_risk, risk_count, risk_factors): five rules, the worst severity first."""
    n_open = opportunity.open_tenders(g).count()
    pressed, bids, lone = stored(_pressed(g), "pressed"), stored(company.bid_counts(g), "bids"), stored(company.single_buyer(g), "single")
    out = pressed.join(bids, "uid", "left").join(lone, "uid", "left").withColumn("bid_count", F.coalesce("bid_count", F.lit(0)))
    rules = [
        ("single_buyer_dependency", "high", F.col("single_buyer")), ("very_low_win_rate", "high", (F.col("bid_count") >= 5) & (F.col("win_rate") < 0.15)),
        ("empty_pipeline", "medium", F.lit(n_open == 0)), ("high_competitive_pressure", "medium", F.col("pressure_score") >= 0.7),
        ("competition_detected", "low", (F.col("direct_competitors") > 0) & (F.col("pressure_score") < 0.7)),
    ]
    factors = F.array_compact(F.array(*[F.when(c, n) for n, _, c in rules]))
    some = lambda s: F.arrays_overlap(factors, F.array(*[F.lit(n) for n, x, _ in rules if x == s]))
    return out.select("uid", F.when(some("high"), "high").when(some("medium"), "medium").otherwise("low").alias("overall_risk"), F.size(factors).alias("risk_count"), factors.alias("risk_factors"))


def decision(g: Graph) -> DataFrame:
    """(uid, situation, market_position, relationship_map, pipeline, risks, narrative): the whole package, a struct a section."""
    out = company_situation(g).select("uid", F.struct("*").alias("situation"))
    for name, f in (("market_position", market_position), ("relationship_map", relationship_map), ("pipeline", opportunity_pipeline), ("risks", risk_register)):
        out = out.join(f(g).select("uid", F.struct("*").alias(name)), "uid", "left")
    text = F.concat_ws(" ", F.format_string("Win rate %.0f%% across %d bids.", F.col("situation.win_rate") * 100, F.col("situation.bid_count")), F.format_string("Classified as %s, pressure %.2f.", F.col("market_position.classification"), F.col("market_position.pressure_score")), F.format_string("Overall risk %s.", F.col("risks.overall_risk")))
    return out.withColumn("narrative", text)
