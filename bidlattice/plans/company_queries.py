"""Registered company, relationship and executive queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import company, executive, relationship
from . import competitive_queries as cq
from . import opportunity_queries as oq
from .oracles import hhi, ratio, sql

QUERIES = {
    "company_summary": company.summary,
    "company_stats": company.stats,
    "company_yearly_stats": company.yearly_stats,
    "company_buyers": company.buyers,
    "company_competitors": company.competitors,
    "company_contracts": company.contracts,
    "company_contract_totals": company.contract_totals,
    "company_tenders": company.tenders,
    "company_timeline": company.timeline,
    "company_yearly_activity": company.yearly_activity,
    "company_locations": company.locations,
    "company_industries": company.industries,
    "top_competitors": company.top_competitors,
    "companies_by_city": lambda g: company.companies_in(g, "city"),
    "companies_by_province": lambda g: company.companies_in(g, "province"),
    "most_connected_companies": company.most_connected,
    "company_profile": lambda g: company.profile(g).select("uid", "summary.tenders_won", "stats.total_value", "contracts.average_value", "buyers.buyer_count"),
    "shared_buyers": relationship.shared_buyers,
    "shared_tenders": relationship.shared_tenders,
    "shared_industries": relationship.shared_industries,
    "shared_locations": relationship.shared_locations,
    "shared_competitors": lambda g: relationship.shared_competitors(g, far=True),
    "relationship_strength": lambda g: relationship.strength(g, far=True),
    "relationship_explain": lambda g: relationship.explain(g, far=True).select("uid_a", "uid_b", "relationship_strength", "explanation_text"),
    "infer_relationships": relationship.infer_relationships,
    "recurring_partnerships": relationship.recurring_partnerships,
    "industry_clusters": relationship.industry_clusters,
    "geographic_clusters": relationship.geographic_clusters,
    "organization_influence": relationship.organization_influence,
    "executive_situation": executive.company_situation,
    "executive_market_position": executive.market_position,
    "executive_relationship_map": executive.relationship_map,
    "executive_opportunity_pipeline": executive.opportunity_pipeline,
    "executive_buyer_landscape": executive.buyer_landscape,
    "executive_strategic_priorities": executive.strategic_priorities,
    "executive_risk_register": lambda g: executive.risk_register(g).withColumn("risk_factors", F.concat_ws("|", "risk_factors")),
    "executive_decision": lambda g: executive.decision(g).select("uid", "situation.health_score", "market_position.classification", "risks.overall_risk", "pipeline.pursue_count"),
}


def _top(inner: str, key: str, order: str, limit: int) -> str:
    return cq._top(inner, key, order, limit)


_SUM = f"""csum as (select company as uid, name, round(least(1.0, 0.3::double + 0.07::double * least(10, edges)), 3) as confidence_score, edges as evidence_count, coalesce(w, 0) as tenders_won, coalesce(s, 0) as tenders_submitted, 0 as permits, 0 as unique_buyers,
  2 as location_count, coalesce(i, 0) as industry_count, coalesce(round(t, 2), 0.0) as total_awarded_value, coalesce(round(a, 2), 0.0) as average_contract_value, coalesce(round(x, 2), 0.0) as largest_contract
  from (select home.company, name, w, s, i, t, a, x, coalesce(w, 0) + coalesce(s, 0) + 2 + coalesce(i, 0) as edges from home
    left join (select company, count(*) filter (is_win) as w, count(*) filter (not is_win) as s, sum(cv) as t, avg(cv) as a, max(cv) as x from tp group by 1) using (company) left join (select company, count(*) as i from ci group by 1) using (company)))"""
_CB = "cbuy as (select company as uid, buyer, count(*) as tender_count from tp join tb using (tender) group by 1, 2)"
_TOT = "ctot as (select company as uid, count(*) as contract_count, round(sum(cv), 2) as total_value, round(sum(cv) / count(*), 2) as average_value, max(cv) as largest_contract from tp where is_win group by 1)"
_STATS = """cst as (select company as uid, count(cv) as contract_count, coalesce(round(sum(cv), 2), 0.0) as total_contract_value, coalesce(round(avg(cv), 2), 0.0) as average_contract_value, coalesce(round(max(cv), 2), 0.0) as largest_contract,
  coalesce(round(min(cv), 2), 0.0) as smallest_contract, 0 as permit_count, 0.0 as total_permit_value, coalesce(round(sum(cv), 2), 0.0) as total_value, cast(null as varchar) as first_activity, cast(null as varchar) as latest_activity from tp group by 1)"""
_EVENTS = "ev as (select company as uid, strftime(closing, '%Y-%m-%d') as date, case when is_win then 'awarded_to' else 'submitted_bid' end as event_type, tender as counterpart from tp join tf using (tender))"


def _pair(name: str, members: str, key: str, count: str) -> str:
    return f"{name} as (select a.company as uid_a, b.company as uid_b, count(*) as {count} from ({members}) a join ({members}) b using ({key}) where a.company < b.company group by 1, 2)"


_SB = _pair("sb", "select distinct company, buyer from tp join tb using (tender)", "buyer", "shared_buyer_count")
_ST = _pair("st", "select company, tender from tp", "tender", "co_appearances")
_SI = _pair("si", "select company, industry from ci", "industry", "shared_industry_count")
_SL = _pair("sl", "select company, city as place from home union all select company, province from home", "place", "shared_location_count")
_SC = """rv as (select distinct a.company, c.company as third from tp a join tp c using (tender) where a.company <> c.company),
sc as (select uid_a, uid_b, count(distinct c.company) as shared_competitor_count from (select a.company as uid_a, b.company as uid_b, tender from tp a join tp b using (tender) where a.company < b.company) p
  join tp c on c.tender = p.tender and c.company <> p.uid_a and c.company <> p.uid_b group by 1, 2
  union all select * from (select a.company as uid_a, b.company as uid_b, count(*) as shared_competitor_count from rv a join rv b using (third) where a.company < b.company group by 1, 2) f
    where not exists (select 1 from rv where rv.company = f.uid_a and rv.third = f.uid_b))"""
_REL = """rel as (select uid_a, uid_b, coalesce(shared_buyer_count, 0) as shared_buyer_count, coalesce(shared_competitor_count, 0) as shared_competitor_count, coalesce(shared_industry_count, 0) as shared_industry_count,
  coalesce(shared_location_count, 0) as shared_location_count, coalesce(co_appearances, 0) as co_appearances, 0 as direct_count
  from sb full join st using (uid_a, uid_b) full join si using (uid_a, uid_b) full join sl using (uid_a, uid_b) full join sc using (uid_a, uid_b)),
reln as (select *, shared_buyer_count + shared_competitor_count + shared_industry_count + shared_location_count + co_appearances as evidence_count from rel),
rels as (select *, round(least(1.0::double, 1 - pow(0.7::double, evidence_count)), 4) as relationship_strength from reln)"""


def _eq(n: str, w: float) -> str:
    return f"round(least(1.0::double, {w}::double * (1 - pow(0.7::double, {n})) / 0.3::double), 4)"


def _conf(s: str, n: str) -> str:
    return f"round(least(1.0::double, 0.5::double * {s} + 0.5::double * least(1.0::double, {n} / 3.0::double)), 4)"


def _both(table: str, count: str) -> str:
    return f"select uid_a as uid, uid_b as other, {count} as n from {table} union all select uid_b, uid_a, {count} from {table}"


def _family(name: str, inner: str, w: float, limit: int = 50) -> str:
    return f"select *, '{name}' as family from ({_top(f'select uid, other, n, {_eq("n", w)} as strength, {_conf(_eq("n", w), "n")} as confidence from ({inner})', 'uid', 'n desc, other', limit)})"


def _inferred(limit: int) -> str:
    parts = [
        _family("shared_buyer", _both("sb", "shared_buyer_count"), 0.3, limit),
        _family("subcontractor_hint", "select a.company as uid, b.company as other, count(*) as n from tp a join tp b using (tender) where not a.is_win and b.is_win and a.company <> b.company group by 1, 2", 0.6, limit),
        _family("industry_cluster_peer", _both("si", "shared_industry_count"), 0.4, limit),
        _family("geographic_cluster_peer", _both("sl", "shared_location_count"), 0.3, limit),
    ]
    return " union all ".join(parts)


_PARTNERS = "select a.company as uid, b.company as other, count(*) as co_event_count from tp a join tp b using (tender) where a.company <> b.company group by 1, 2"
_GROW = """gt as (select uid, case when max(prior) is null then 'insufficient_data' when max(last) > max(prior) * 1.1::double then 'growing' when max(last) < max(prior) * 0.9::double then 'declining' else 'stable' end as trend
  from (select uid, first_value(n) over w as last, nth_value(n, 2) over w as prior from (select company as uid, y, count(*) as n from tp join tf using (tender) group by 1, 2) window w as (partition by uid order by y desc rows between unbounded preceding and unbounded following)) group by 1)"""
_SITUATION = """sit as (select home.company as uid, coalesce(score, 0.0) as win_rate, tenders_won + tenders_submitted as bid_count, coalesce(trend, 'insufficient_data') as trend, top_buyer,
  round((coalesce(score, 0.0) + least(1.0::double, (tenders_won + tenders_submitted) / 20.0::double)) / 2, 4) as health_score, confidence_score as confidence
  from home join csum on csum.uid = home.company left join rate on rate.uid = home.company left join gt on gt.uid = home.company
  left join (select uid, buyer as top_buyer from (select *, row_number() over (partition by uid order by tender_count desc, buyer) as k from cbuy) where k = 1) t on t.uid = home.company)"""
_POSITION = """press as (select uid, p as pressure_score, case when p >= 0.65 then 'high' when p >= 0.35 then 'medium' else 'low' end as pressure_level, wr from (select uid, wr, round(0.3::double * d + 0.35::double * w + 0.2::double * i + 0.15::double * h, 4) as p from (
  select home.company as uid, coalesce(score, 0.0) as wr, least(1.0, coalesce(rivals, 0) / 20.0::double) as d, round(1 - coalesce(score, 0.0), 4) as w, least(1.0, coalesce(co, 0.0) / 5.0::double) as i, coalesce(bh, 0.0) as h
  from home left join rate on uid = home.company left join (select company, count(distinct rival) as rivals from met group by 1) r using (company)
  left join (select company, avg(n - 1) as co from tp join (select tender, count(*) as n from tp group by 1) using (tender) group by 1) e using (company)
  left join (select company, avg(coalesce(hhi, 0.0)) as bh from (select company, buyer, row_number() over (partition by company order by buyer) as k from (select distinct company, buyer from tp join tb using (tender)))
    left join (select scope, """ + hhi("wins") + """ as hhi from scope_wins group by 1) on scope = buyer where k <= 3 group by 1) b using (company)))),
dc as (select uid, least(5, count(*)) as direct_competitors from (select company as uid, rival from met union select x.company, z.company from cb0 x join cb0 z using (buyer) where x.company <> z.company) group by 1),
em as (select company as uid, least(3, count(*)) as emerging_threats from (select company, rival, count(*) filter (y >= 1999) as r, count(*) filter (y < 1999) as o from met join tf using (tender) group by 1, 2) where r > 0 and (o = 0 or r > o) group by 1),
pos as (select uid, pressure_score, pressure_level, case when wr >= 0.5 then 'incumbent' when wr >= 0.2 then 'challenger' else 'emerging' end as classification, round(1 - round(1 - wr, 4), 4) as win_rate, coalesce(direct_competitors, 0) as direct_competitors, coalesce(emerging_threats, 0) as emerging_threats
  from press left join dc using (uid) left join em using (uid))"""
_CB0 = "cb0 as (select distinct company, buyer from tp join tb using (tender))"
_ALL = (cq._MET, cq._DOM, _CB0, _POSITION)
_BASE = (oq._OPEN, oq._FEATURES, oq._BEST)
_PIPE = f"""pipe as (select company as uid, total_scored, coalesce(pursue_count, 0) as pursue_count, {ratio("pursue_count", "total_scored")} as pipeline_health, best_tender, best_score
  from (select company, count(*) as total_scored from pairs group by 1) left join (select company, count(*) filter (score >= 50) as pursue_count, arg_min(tender, rank) as best_tender, max(score) as best_score from best where rank <= 10 group by 1) using (company))"""
_RISK = """risk as (select uid, concat_ws('|', case when b = 1 then 'single_buyer_dependency' end, case when bid_count >= 5 and win_rate < 0.15 then 'very_low_win_rate' end, case when coalesce(t, 0) = 0 then 'empty_pipeline' end,
    case when pressure_score >= 0.7 then 'high_competitive_pressure' end, case when direct_competitors > 0 and pressure_score < 0.7 then 'competition_detected' end) as risk_factors,
  (coalesce(b = 1, false)::int + (bid_count >= 5 and win_rate < 0.15)::int + (coalesce(t, 0) = 0)::int + (pressure_score >= 0.7)::int + (direct_competitors > 0 and pressure_score < 0.7)::int)::int as risk_count,
  case when coalesce(b = 1, false) or bid_count >= 5 and win_rate < 0.15 then 'high' when coalesce(t, 0) = 0 or pressure_score >= 0.7 then 'medium' else 'low' end as overall_risk
  from (select pos.*, bid_count from pos join sit using (uid)) left join (select uid, count(*) as b from cbuy group by 1) using (uid) left join (select company as uid, count(*) as t from home cross join tf where closing >= date '2001-08-02' group by 1) using (uid))"""

ORACLES = {
    "company_summary": sql("select * from csum", _SUM),
    "company_stats": sql("select * from cst", _STATS),
    "company_yearly_stats": sql("select company as uid, 'unknown' as year, count(*) as contract_count, coalesce(round(sum(cv), 2), 0.0) as contract_value, 0 as permit_count, 0.0 as permit_value from tp group by 1"),
    "company_buyers": sql("select * from cbuy", _CB),
    "company_competitors": sql(_top("select a.company as uid, b.company as rival, count(*) as shared_tenders, 0 as shared_buyers, count(*) as shared_evidence_count from tp a join tp b using (tender) where b.is_win and a.company <> b.company group by 1, 2", "uid", "shared_evidence_count desc, rival", 20)),
    "company_contracts": sql("select company as uid, tender as contract, 'tender' as entity_kind, 'awarded_to' as relation, cv as contract_value, cast(null as varchar) as award_date, cast(null as varchar) as url from tp where is_win"),
    "company_contract_totals": sql("select * from ctot", _TOT),
    "company_tenders": sql("select company as uid, tender, case when is_win then 'awarded_to' else 'submitted_bid' end as relation, category, strftime(closing, '%Y-%m-%d') as closing_date, cv as contract_value, is_win as won from tp join tf using (tender)"),
    "company_timeline": sql("select * from ev", _EVENTS),
    "company_yearly_activity": sql("select uid, substr(date, 1, 4) as year, count(*) as events, min(date) as first_event, max(date) as latest_event from ev group by 1, 2", _EVENTS),
    "company_locations": sql("select company as uid, city as location, 'in_city' as relation, city_name as name from home union all select company, province, 'in_province', province_name from home"),
    "company_industries": sql("select company as uid, industry_name as name, false as inferred, 1 as evidence_count, cast(null as varchar) as example_tender from ci union all select company, category, true, count(*), min(tender) from tp join tf using (tender) where is_win group by 1, 2"),
    "top_competitors": sql("select company as uid, count(distinct buyer) as buyer_count from tp join tb using (tender) where is_win group by 1 order by 2 desc, 1 limit 20"),
    "companies_by_city": sql("select city as place, city_name as place_name, company as uid, name from home"),
    "companies_by_province": sql("select province as place, province_name as place_name, company as uid, name from home"),
    "most_connected_companies": sql("select uid, evidence_count as out_edges, 0 as in_edges, evidence_count as total_edges from csum order by 2 desc, 1 limit 20", _SUM),
    "company_profile": sql("select uid, tenders_won, cst.total_value, average_value, buyer_count from csum left join cst using (uid) left join ctot using (uid) left join (select uid, count(*) as buyer_count from cbuy group by 1) using (uid)", _SUM, _STATS, _TOT, _CB),
    "shared_buyers": sql("select * from sb", _SB),
    "shared_tenders": sql("select * from st", _ST),
    "shared_industries": sql("select * from si", _SI),
    "shared_locations": sql("select * from sl", _SL),
    "shared_competitors": sql("select * from sc", _SC),
    "relationship_strength": sql(f"select *, {_conf('relationship_strength', 'evidence_count')} as confidence from rels", _SB, _ST, _SI, _SL, _SC, _REL),
    "relationship_explain": sql(
        "select uid_a, uid_b, relationship_strength, concat_ws('; ', " + ", ".join(f"case when {c} > 0 then {c} || ' {what}' end" for c, what in relationship.SIGNALS.items() if c != "direct_count") + ") as explanation_text from rels", _SB, _ST, _SI, _SL, _SC, _REL),
    "infer_relationships": sql(_inferred(50), _SB, _SI, _SL),
    "recurring_partnerships": sql(f"select uid, other, co_event_count, {_eq('co_event_count', 1.0)} as strength, {_conf(_eq('co_event_count', 1.0), 'co_event_count')} as confidence from ({_PARTNERS}) where co_event_count >= 2"),
    "industry_clusters": sql(f"select industry, company as uid, coalesce(wins, 0) as tender_count, {_eq('coalesce(wins, 0)', 1.0)} as strength from ci left join won using (company)"),
    "geographic_clusters": sql("select city as location, company as uid, name from home union all select province, company, name from home"),
    "organization_influence": sql("select buyer as org, tender_count, coalesce(n, 0) as company_count, 0.0 as total_contract_value, round(least(1.0::double, 0.1::double * coalesce(n, 0)), 4) as influence_score from (select buyer, count(*) as tender_count from tb group by 1) left join (select buyer, count(distinct company) as n from tp join tb using (tender) group by 1) using (buyer)"),
    "executive_situation": sql("select * from sit", _SUM, _CB, cq._DOM, _GROW, _SITUATION),
    "executive_market_position": sql("select * from pos", *_ALL),
    "executive_relationship_map": sql(
        f"""select company as uid, coalesce(p, 0) as partner_count, coalesce(i, 0) as inferred_count, 0 as chain_count from home left join (select uid, least(10, count(*)) as p from ({_PARTNERS}) group by 1) p on p.uid = company
        left join (select uid, least(10, count(*)) as i from ({_inferred(10)}) group by 1) i on i.uid = company""", _SB, _SI, _SL),
    "executive_opportunity_pipeline": sql("select * from pipe", *_BASE, _PIPE),
    "executive_buyer_landscape": sql("select uid, buyer, n as tenders_issued from cbuy join (select buyer, count(*) as n from tb group by 1) using (buyer)", _CB),
    "executive_strategic_priorities": sql(_top(
        """select *, case when score >= 0.75 then 'critical' when score >= 0.5 then 'high' when score >= 0.25 then 'medium' else 'low' end as level from (
        select company as uid, 'pursue_opportunity' as label, tender as subject, round(score / 100, 4) as score from best where rank <= 3
        union all select uid, 'deepen_buyer_relationship', buyer, 0.55 from (select *, row_number() over (partition by uid order by tender_count desc, buyer) as k from cbuy) where k <= 2
        union all select home.company, 'build_market_presence', '', 0.65 from home left join rate on uid = home.company where coalesce(score, 0.0) < 0.2)""", "uid", "score desc, label, subject", 10), *_BASE, _CB, cq._DOM),
    "executive_risk_register": sql("select * from risk", *_ALL, _SUM, _CB, _GROW, _SITUATION, _RISK),
    "executive_decision": sql("select uid, health_score, classification, overall_risk, pursue_count from sit join pos using (uid) join risk using (uid) join pipe using (uid)", *_BASE, _PIPE, *_ALL, _SUM, _CB, _GROW, _SITUATION, _RISK),
}
