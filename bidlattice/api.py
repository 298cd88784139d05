"""All operations by name, for callers that ask about one entity: results are rows as dictionaries, or an error record.

Each operation filters the all-keys DataFrame on its key, so Catalyst pushes the key down where the plan allows; work on
many keys should use the operators themselves."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import buyer, company, competitive, executive, opportunity, relationship, search, store, traverse
from .operators.views import Graph
from .sources.code import CodeGraph


class Engine:
    """Operations on one graph, and on a code graph and a history table where they are given."""

    def __init__(self, graph: Graph, code: CodeGraph | None = None, history: DataFrame | None = None):
        self.g, self.code, self.history = graph, code, history

    def call(self, tool: str, **args) -> dict:
        """The result of a tool: ``{"rows": [...], "count": n}``, or ``{"error": text}`` for unknown tools, missing or
        wrong-kind entities."""
        if tool not in TOOLS:
            return {"error": f"no such tool: {tool}"}
        run, kinds = TOOLS[tool]
        for name in ("uid", "uid_a", "uid_b", "company_uid", "tender_uid"):
            if name in args and (problem := self._missing(args[name], kinds if name == "uid" else ())):
                return {"error": problem}
        df = run(self, **args)
        if df is None:
            return {"error": "this engine has no such table"}
        rows = [json.loads(r) for r in df.toJSON().collect()]
        return {"rows": rows, "count": len(rows)}

    def _missing(self, uid: str, kinds: tuple) -> str | None:
        found = store.get(self.g, uid).select("kind").first()
        if found is None:
            return f"no entity {uid}"
        return f"{uid} is of kind {found.kind}, not {' or '.join(kinds)}" if kinds and found.kind not in kinds else None

    def seed(self, uid: str, name: str = "uid") -> DataFrame:
        return self.g.entities.sparkSession.createDataFrame([(uid,)], f"{name} string")

    def pair(self, a: str, b: str, names: str) -> DataFrame:
        return self.g.entities.sparkSession.createDataFrame([(a, b)], names)


def _keyed(f: Callable, key: str = "uid", **fixed) -> Callable:
    """An all-keys operator as one of a single key; ``limit`` keeps the first rows by the operator's own order."""

    def run(e: Engine, uid: str, **args):
        return f(e.g, **fixed | args).filter(F.col(key) == uid)

    return run


def _rivals(f: Callable) -> Callable:
    return lambda e, uid, **args: f(e.g, companies=e.seed(uid, "company"), **args)


def _whole(f: Callable) -> Callable:
    return lambda e, **args: f(e.g, **args)


def _pairwise(f: Callable) -> Callable:
    return lambda e, uid_a, uid_b: f(e.g, e.pair(uid_a, uid_b, "uid_a string, uid_b string")).filter((F.col("uid_a") == min(uid_a, uid_b)) & (F.col("uid_b") == max(uid_a, uid_b)))


def _offer(f: Callable) -> Callable:
    return lambda e, company_uid, tender_uid, **args: f(e.g, e.pair(company_uid, tender_uid, "company string, tender string"), **args)


def _chosen(f: Callable) -> Callable:
    return lambda e, uid, open_only=True, **args: f(e.g, opportunity.every_pair(e.g, e.seed(uid, "company"), open_only), **args)


def _path(e: Engine, uid_a: str, uid_b: str, max_depth: int = 6, kinds: list[str] | None = None) -> DataFrame:
    return traverse.paths(e.g, e.pair(uid_a, uid_b, "start string, goal string"), max_depth, kinds)


def _code(f: Callable) -> Callable:
    return lambda e, **args: f(e.code, **args) if e.code is not None else None


def _competitor_profile(e: Engine, uid: str) -> DataFrame:
    g = e.g
    parts = {"direct_competitors": competitive.direct_competitors, "emerging_competitors": competitive.emerging_competitors, "co_bidders": competitive.co_bidders, "common_losers": competitive.common_losers}
    out = competitive.win_rate(g).filter(F.col("uid") == uid).join(competitive.competitive_pressure(g), "uid")
    for name, f in parts.items():
        mine = f(g, companies=e.seed(uid, "company")).groupBy("uid").agg(F.collect_list(F.struct("*")).alias(name))
        out = out.join(mine, "uid", "left")
    return out


def _history(e: Engine, uid: str) -> DataFrame | None:
    return None if e.history is None else e.history.filter(F.col("uid") == uid).orderBy("changed_at")


_C, _B = ("company",), ("organization", "company")

#: Tool name: (operation, kinds that ``uid`` may have).
TOOLS: dict[str, tuple[Callable, tuple]] = {
    "kg_search": (_code(CodeGraph.search), ()), "kg_entity_detail": (_code(lambda c, name: c.entities.filter(F.col("qualified_name") == name)), ()), "kg_file_outline": (_code(CodeGraph.outline), ()),
    "kg_callers": (_code(CodeGraph.callers), ()), "kg_callees": (_code(CodeGraph.callees), ()), "kg_inheritance": (_code(lambda c, qualified_name: c.inheritance(qualified_name)[0].withColumn("side", F.lit("ancestor")).unionByName(c.inheritance(qualified_name)[1].withColumn("side", F.lit("descendant")))), ()),
    "kg_imports": (_code(CodeGraph.imports), ()), "kg_api_routes": (_code(CodeGraph.routes), ()), "kg_sql_tables": (_code(CodeGraph.tables), ()), "kg_table_usage": (_code(CodeGraph.table_usage), ()),
    "kg_subgraph": (_code(lambda c, qualified_name, depth=2: c.subgraph(qualified_name, depth)[1]), ()), "kg_context_pack": (_code(CodeGraph.context_pack), ()), "kg_stats": (_code(CodeGraph.statistics), ()),
    "biz_search": (lambda e, query, **a: search.entities(e.g, query, **a), ()), "biz_entity": (lambda e, uid: store.get(e.g, uid), ()), "biz_neighbors": (lambda e, uid, **a: traverse.neighbors(e.g, e.seed(uid), **a), ()),
    "biz_find_path": (_path, ()), "biz_related_companies": (lambda e, uid, **a: traverse.related_companies(e.g, e.seed(uid), **a), ()), "biz_contracts": (_keyed(company.contracts), _C), "biz_stats": (_whole(store.statistics), ()),
    "biz_entity_history": (_history, ()), "biz_list": (lambda e, kind, limit=50, offset=0: store.find(e.g, kind, None, limit, offset), ()), "biz_find_companies": (lambda e, name, **a: search.find_companies(e.g, name, **a), ()),
    "cie_profile": (_keyed(company.profile), _C), "cie_summary": (_keyed(company.summary), _C), "cie_stats": (_keyed(company.stats), _C), "cie_buyers": (_keyed(company.buyers), _C), "cie_competitors": (_keyed(company.competitors), _C),
    "cie_contracts": (_keyed(company.contracts), _C), "cie_tenders": (_keyed(company.tenders), _C), "cie_timeline": (_keyed(company.timeline), _C), "cie_locations": (_keyed(company.locations), _C), "cie_industries": (_keyed(company.industries), _C),
    "cie_top_competitors": (_whole(company.top_competitors), ()), "cie_companies_by_city": (lambda e, city: company.companies_in(e.g, "city", city), ()), "cie_companies_by_province": (lambda e, province: company.companies_in(e.g, "province", province), ()),
    "cie_most_connected": (_whole(company.most_connected), ()), "cie_identity": (_keyed(store.company_identity), _C),
    "rie_explain": (_pairwise(relationship.explain), ()), "rie_strength": (_pairwise(relationship.strength), ()), "rie_path": (_path, ()), "rie_infer": (_keyed(relationship.infer_relationships), ()),
    "rie_partnerships": (_keyed(relationship.recurring_partnerships), ()), "rie_industry_cluster": (_keyed(relationship.industry_clusters, "industry"), ("industry",)), "rie_geo_cluster": (_keyed(relationship.geographic_clusters, "location"), ("city", "province")),
    "rie_org_influence": (_keyed(relationship.organization_influence, "org"), ()), "rie_shared_buyers": (_pairwise(relationship.shared_buyers), ()), "rie_shared_competitors": (_pairwise(relationship.shared_competitors), ()), "rie_subcontractor_chains": (_keyed(relationship.subcontractor_chains), ()),
    "cei_competitor_profile": (_competitor_profile, _C), "cei_win_rate": (_keyed(competitive.win_rate), _C), "cei_growth_trend": (_keyed(competitive.growth_trend), _C), "cei_direct_competitors": (_rivals(competitive.direct_competitors), _C),
    "cei_emerging_competitors": (_rivals(competitive.emerging_competitors), _C), "cei_co_bidders": (_rivals(competitive.co_bidders), _C), "cei_common_losers": (_rivals(competitive.common_losers), _C), "cei_buyer_preferences": (_keyed(competitive.buyer_preferences, "buyer"), _B),
    "cei_market_concentration": (_keyed(competitive.market_concentration, "scope"), ()), "cei_market_share": (_keyed(competitive.market_share, "scope"), ()), "cei_dominant_suppliers": (_keyed(competitive.dominant_suppliers, "scope"), ()),
    "cei_challenger_companies": (_keyed(competitive.challenger_companies, "scope"), ()), "cei_competitor_rankings": (_keyed(competitive.competitor_rankings, "scope"), ()), "cei_competitive_pressure": (_keyed(competitive.competitive_pressure), _C),
    "oie_opportunity_profile": (_offer(opportunity.profile), ()), "oie_opportunity_score": (_offer(opportunity.score), ()), "oie_opportunity_recommendation": (_offer(opportunity.recommendation), ()), "oie_opportunity_explain": (_offer(opportunity.explain), ()),
    "oie_opportunity_timeline": (_offer(opportunity.timeline), ()), "oie_opportunity_risk": (_offer(opportunity.risk), ()), "oie_portfolio_impact": (_offer(opportunity.portfolio_impact), ()), "oie_similar_opportunities": (_offer(opportunity.similar_opportunities), ()),
    "oie_best_opportunities": (_chosen(opportunity.best_opportunities), _C), "oie_executive_summary": (_chosen(opportunity.executive_summary), _C),
    "bie_buyer_profile": (_keyed(buyer.profile), _B), "bie_buyer_summary": (_keyed(buyer.summary), _B), "bie_supplier_roster": (_keyed(buyer.supplier_roster), _B), "bie_preferred_suppliers": (_keyed(buyer.preferred_suppliers), _B),
    "bie_supplier_loyalty": (_keyed(buyer.supplier_loyalty), _B), "bie_supplier_diversity": (_keyed(buyer.supplier_diversity), _B), "bie_buying_patterns": (_keyed(buyer.buying_patterns), _B), "bie_procurement_seasonality": (_keyed(buyer.procurement_seasonality), _B),
    "bie_preferred_industries": (_keyed(buyer.preferred_industries), _B), "bie_preferred_contract_sizes": (_keyed(buyer.preferred_contract_sizes), _B), "bie_avg_procurement_value": (_keyed(buyer.avg_procurement_value), _B), "bie_avg_bidder_count": (_keyed(buyer.avg_bidder_count), _B),
    "bie_award_concentration": (_keyed(buyer.award_concentration), _B), "bie_buyer_competitiveness": (_keyed(buyer.buyer_competitiveness), _B), "bie_buyer_timeline": (_keyed(buyer.buyer_timeline), _B), "bie_tender_forecast": (_keyed(buyer.tender_forecast), _B),
    "ede_executive_decision": (_keyed(executive.decision), _C), "ede_company_situation": (_keyed(executive.company_situation), _C), "ede_market_position": (_keyed(executive.market_position), _C), "ede_relationship_map": (_keyed(executive.relationship_map), _C),
    "ede_opportunity_pipeline": (lambda e, uid, **a: executive.opportunity_pipeline(e.g, opportunity.every_pair(e.g, e.seed(uid, "company")), **a), _C), "ede_buyer_landscape": (_keyed(executive.buyer_landscape), _C), "ede_strategic_priorities": (_keyed(executive.strategic_priorities), _C), "ede_risk_register": (_keyed(executive.risk_register), _C),
}


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, rows: int = 20) -> str:
    """A text table of the first rows."""
    return df._show_string(rows, False)


def confidence_scores(g: Graph) -> DataFrame:
    """(uid, score): how well a company is documented: identifiers 0.30, aliases 0.25, same-as links 0.10, activity 0.20, sources 0.15."""
    ids = F.size(F.map_filter("attributes", lambda k, v: F.array_contains(F.array(*[F.lit(x) for x in store.schema.EXTERNAL_ID_KEYS]), k)))
    n = g.adjacency.filter(X.is_kind("uid", "company")).groupBy("uid").agg(F.count_if((F.col("relation") == "alias_of") & (F.col("direction") == "in")).alias("aliases"), F.count_if(F.col("relation") == "same_as").alias("same"), F.count("*").alias("edges"))
    out = g.nodes("company").select("uid", ids.alias("ids"), F.col("source").isNotNull().cast("int").alias("sources")).join(n, "uid", "left")
    part = lambda c, most, w: F.least(F.lit(1.0), F.coalesce(c, F.lit(0)) / most) * w
    return out.select("uid", X.rounded(part("ids", 3.0, 0.30) + part("aliases", 2.0, 0.25) + part("same", 1.0, 0.10) + part("edges", 10.0, 0.20) + part("sources", 1.0, 0.15), 4).alias("score"))


def score_histogram(scores: DataFrame, bands: int = 10) -> DataFrame:
    """(band, n) of scores from 0 to 1, and by ``percentiles`` their p50, p90, p95 and p99."""
    return scores.groupBy(F.least(F.floor(F.col("score") * bands), F.lit(bands - 1)).cast("int").alias("band")).agg(F.count("*").alias("n"))


def percentiles(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.percentile("score", p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)])


def counts_by_source(g: Graph) -> DataFrame:
    return g.entities.groupBy("source", "kind").agg(F.count("*").alias("n"))
