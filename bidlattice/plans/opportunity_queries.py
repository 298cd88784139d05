"""Registered opportunity queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import opportunity as o
from .oracles import sql

_TEXTS = lambda df, *names: df.withColumns({n: F.concat_ws("|", n) for n in names})


def _running(g):
    """Pairs of companies with open tenders they take part in."""
    return o.taking_part(g).join(o.open_tenders(g), "tender", "left_semi")


QUERIES = {
    "opportunity_score": lambda g: o.score(g, o.taking_part(g)).select("company", "tender", *o.WEIGHTS, "score"),
    "opportunity_recommendation": lambda g: _TEXTS(o.recommendation(g, o.taking_part(g)), "why_pursue", "why_ignore", "next_actions"),
    "opportunity_explain": lambda g: o.explain(g, o.taking_part(g)).select("company", "tender", "tender_value", "tender_date", "tender_deadline", "buyer", "score", "capability_points", "strategic_points"),
    "opportunity_timeline": lambda g: o.timeline(g, o.taking_part(g)),
    "opportunity_risk": lambda g: _TEXTS(o.risk(g, o.taking_part(g)), "risk_factors", "mitigations"),
    "portfolio_impact": lambda g: o.portfolio_impact(g, o.taking_part(g)),
    "similar_opportunities": lambda g: o.similar_opportunities(g, _running(g)),
    "best_opportunities": o.best_opportunities,
    "opportunity_executive_summary": o.executive_summary,
    "opportunity_profile": lambda g: o.profile(g, o.taking_part(g)).select("company", "tender", "explain.score", "timeline.submission_urgency", "risk.overall_risk", "portfolio.expected_revenue"),
}

_FEATURES = """
ti as (select tender, list_sort(list(distinct industry)) as inds from tp join ci using (company) group by 1),
mine as (select company, list(distinct industry) as mine from ci group by 1),
bk as (select *, case when value < 0 then 'mega' when value < 25000 then 'micro' when value < 250000 then 'small' when value < 2500000 then 'medium' when value < 25000000 then 'large' else 'mega' end as bucket from tf),
cs as (select company, count(*) as c_bids, count(*) filter (is_win) as c_wins, count(*) filter (y in (2001, 2000)) as c_recent, count(*) filter (bucket = 'micro') as n0, count(*) filter (bucket = 'small') as n1,
  count(*) filter (bucket = 'medium') as n2, count(*) filter (bucket = 'large') as n3, count(*) filter (bucket = 'mega') as n4 from tp join bk using (tender) group by 1),
cb as (select company, buyer, count(*) as cb_bids, count(*) filter (is_win) as cb_wins from tp join tb using (tender) group by 1, 2),
sz as (select buyer, count(*) as b_tenders from tb group by 1),
nc as (select tender, count(*) as n_comp from tp group by 1),
base as (
  select p.company, p.tender, bk.value, bk.d, bk.closing, bk.bucket, tb.buyer, ti.inds, n_comp, b_tenders, cb_bids, cb_wins, cs.*exclude (company), mine, lower(h.city_name) as c1, lower(h.province_name) as p1, lower(org.city_name) as c2, lower(org.province_name) as p2
  from pairs p join bk using (tender) left join tb using (tender) left join ti using (tender) left join nc using (tender) left join sz using (buyer) left join org using (buyer)
  left join cb on cb.company = p.company and cb.buyer = tb.buyer left join cs on cs.company = p.company left join mine on mine.company = p.company left join home h on h.company = p.company),
sets as (select company, coalesce(inds, []) as theirs, count(*) as bids, count(*) filter (is_win) as wins from tp left join ti using (tender) group by 1, 2),
want as (select distinct company, inds from base where inds is not null),
ih as (select w.company, w.inds, sum(bids) as rel_bids, sum(wins) as rel_wins from want w join sets s on s.company = w.company and list_has_any(w.inds, s.theirs) group by 1, 2),
dims as (
  select *, round(case when mine is null or inds is null then 0.5 else len(list_intersect(inds, mine)) / len(inds)::double end, 4) as capability,
    round(case when buyer is null or coalesce(cb_bids, 0) = 0 then 0.3 else least(1.0, cb_wins / cb_bids::double + least(1.0, cb_bids / 10.0::double) * 0.1::double) end, 4) as buyer_history,
    round(case when inds is null then 0.4 when coalesce(rel_bids, 0) = 0 then 0.3 else rel_wins::double / rel_bids::double end, 4) as industry_history,
    round(case when coalesce(n0 + n1 + n2 + n3 + n4, 0) = 0 then 0.5 else least(1.0, (case bucket when 'micro' then n0 + n1 * 0.5::double when 'small' then n1 + (n0 + n2) * 0.5::double when 'medium' then n2 + (n1 + n3) * 0.5::double
      when 'large' then n3 + (n2 + n4) * 0.5::double else n4 + n3 * 0.5::double end) / (n0 + n1 + n2 + n3 + n4)::double) end, 4) as value_fit,
    round(case when buyer is null then 0.5 when c2 in (c1, p1) then 1.0 when p2 in (c1, p1) then 0.7 else 0.2 end, 4) as geo_fit,
    round(case when coalesce(n_comp, 0) = 0 then 0.5 when n_comp <= 2 then 0.9 when n_comp <= 5 then 0.7 when n_comp <= 10 then 0.4 else greatest(0.1::double, 1 - n_comp / 20.0::double) end, 4) as competition,
    round(case when buyer is null then 0.3 when b_tenders <= 2 then 0.4 when b_tenders <= 10 then 0.6 when b_tenders <= 30 then 0.8 else 0.95 end, 4) as buyer_attractiveness,
    round(least(1.0::double, 0.3::double + case when buyer is null then 0.0 when coalesce(cb_bids, 0) = 0 then 0.3 else 0.1 end::double + 0.15::double * case when inds is null then 0 when mine is null then len(inds) else len(list_filter(inds, lambda x: not list_contains(mine, x))) end), 4) as strategic,
    round(case when coalesce(c_recent, 0) = 0 then 0.9 when c_recent <= 3 then 0.8 when c_recent <= 8 then 0.6 when c_recent <= 15 then 0.4 else greatest(0.1::double, 1 - c_recent / 30.0::double) end, 4) as workload,
    round(case when coalesce(c_bids, 0) = 0 then 0.2 when coalesce(cb_bids, 0) > 0 then (c_wins / c_bids::double + cb_wins / cb_bids::double) / 2 else c_wins / c_bids::double end, 4) as win_probability
  from base left join ih using (company, inds)),
s as (select *, round(capability * 15 + buyer_history * 15 + industry_history * 10 + value_fit * 10 + geo_fit * 10 + competition * 10 + buyer_attractiveness * 10 + strategic * 10 + workload * 5 + win_probability * 5, 1) as score,
  round(date_diff('day', date '2001-08-02', closing) / 30.44::double, 1) as months from dims),
r as (select *, case when score >= 75 then 'Strong Pursue' when score >= 55 then 'Pursue' when score >= 40 and strategic >= 0.6 then 'Strategic Investment' when score >= 35 then 'Monitor' else 'Ignore' end as recommendation,
  case when months <= 0 then 'expired' when months <= 0.5 then 'critical' when months <= 1 then 'high' when months <= 3 then 'medium' else 'low' end as urgency from s)"""
_PART = "pairs as (select company, tender from tp)"
_OPEN = "pairs as (select company, tender from home cross join tf where closing >= date '2001-08-02')"
_LOW = "case when urgency in ('critical', 'expired') then 'high' when urgency = 'high' then 'medium' else 'low' end"


def _joined(*items: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"case when {c} then '{t}' end" for c, t in items) + ")"


_GOING = "recommendation in ('Strong Pursue', 'Pursue')"
_BEST = "best as (select company, tender, score, recommendation, value, buyer, row_number() over (partition by company order by score desc, tender)::int as rank from r)"
_RISKS = (
    ("competition < 0.4", "high_competition", "share_the_bid"), ("capability < 0.3", "capability_gap", "add_skills"), ("capability >= 0.3 and capability < 0.5", "partial_capability", None),
    ("workload < 0.4", "high_workload", "free_staff"), ("buyer_history < 0.25", "no_buyer_history", "meet_the_buyer"), ("value_fit < 0.3", "value_mismatch", "secure_funds"),
    ("geo_fit < 0.4", "geographic_stretch", "find_local_help"), ("urgency in ('critical', 'expired')", "tight_deadline", "begin_now"),
)
_OVERALL = "case when competition < 0.4 or capability < 0.3 or urgency in ('critical', 'expired') then 'high' when capability < 0.5 or workload < 0.4 or buyer_history < 0.25 or value_fit < 0.3 then 'medium' else 'low' end"

ORACLES = {
    "opportunity_score": sql(f"select company, tender, {', '.join(o.WEIGHTS)}, score from s", _PART, _FEATURES),
    "opportunity_recommendation": sql(
        f"""select company, tender, score, recommendation,
        {_joined(("capability >= 0.6", "capability_fits"), ("buyer_history >= 0.5", "buyer_won_before"), ("competition >= 0.7", "few_rivals"), ("strategic >= 0.6", "strategic_gain"))} as why_pursue,
        {_joined(("capability < 0.6", "capability_short"), ("buyer_history < 0.25", "buyer_unproven"), ("competition < 0.4", "many_rivals"), ("workload < 0.4", "busy"))} as why_ignore,
        {_joined((f"{_GOING} and months <= 1", "due_within_a_month"), (_GOING, "staff_the_bid"), (_GOING, "call_the_buyer"), ("recommendation = 'Strategic Investment'", "look_for_a_partner"), ("recommendation = 'Monitor'", "keep_watching"))} as next_actions from r""", _PART, _FEATURES),
    "opportunity_explain": sql("select company, tender, value as tender_value, strftime(d, '%Y-%m-%d') as tender_date, strftime(closing, '%Y-%m-%d') as tender_deadline, buyer, score, round(capability * 15, 1) as capability_points, round(strategic * 10, 1) as strategic_points from r", _PART, _FEATURES),
    "opportunity_timeline": sql(
        f"""select company, tender, bucket as value_bucket, months as months_until_deadline, round(-round(date_diff('day', date '2001-08-02', d) / 30.44::double, 1), 1) as months_since_issue, urgency as submission_urgency,
        case bucket when 'micro' then '1-3 days' when 'small' then '3-7 days' when 'medium' then '1-3 weeks' when 'large' then '2-6 weeks' else '2-4 months' end as preparation_effort, {_LOW} as deadline_risk from r""", _PART, _FEATURES),
    "opportunity_risk": sql(f"select company, tender, score, {_OVERALL} as overall_risk, {_joined(*[(c, n) for c, n, _ in _RISKS])} as risk_factors, {_joined(*[(c, m) for c, _, m in _RISKS if m])} as mitigations from r", _PART, _FEATURES),
    "portfolio_impact": sql(
        """select company, tender, value as tender_value, win_probability, case when value <> 0 then round(value * win_probability, 2) end as expected_revenue,
        case when buyer_history < 0.3 then 'high' when buyer_history < 0.6 then 'medium' else 'low' end as diversification_impact, case when strategic >= 0.6 then 'high' when strategic >= 0.4 then 'medium' else 'low' end as strategic_value,
        buyer is not null and coalesce(cb_bids, 0) = 0 as is_new_client, case when buyer is not null and coalesce(cb_bids, 0) = 0 then 'high' else 'low' end as client_expansion_value,
        case when b_tenders >= 10 then 'high' when b_tenders >= 3 then 'medium' else 'low' end as future_relationship_potential from r""", _PART, _FEATURES),
    "similar_opportunities": sql(
        """select company, tender, similar_tender, outcome, similarity, same_buyer, shared_industries, same_bucket from (select *, row_number() over (partition by company, tender order by similarity desc, similar_tender) as k from (
        select p.company, p.tender, q.tender as similar_tender, case when q.is_win then 'win' else 'loss' end as outcome, f.buyer = z.buyer as same_buyer, coalesce(len(list_intersect(f.inds, z.inds)), 0)::int as shared_industries, f.bucket = z.bucket as same_bucket,
          round(case when f.buyer = z.buyer then 0.5 else 0 end + case when coalesce(len(list_intersect(f.inds, z.inds)), 0) > 0 then 0.3 else 0 end + case when f.bucket = z.bucket then 0.2 else 0 end, 2) as similarity
        from pairs p join tx f using (tender) join tp q on q.company = p.company and q.tender <> p.tender join tx z on z.tender = q.tender) where similarity > 0) where k <= 10""",
        _PART.replace("from tp", "from tp join tf using (tender) where closing >= date '2001-08-02'"), _FEATURES, "tx as (select tender, bucket, buyer, inds from bk join tb using (tender) left join ti using (tender))"),
    "best_opportunities": sql("select * from best where rank <= 10", _OPEN, _FEATURES, _BEST),
    "opportunity_executive_summary": sql(
        f"""select company, count(*) as scored, least(count(*) filter ({_GOING}), 5) as pursue, count(*) filter (recommendation = 'Ignore') as "ignore", arg_min(tender, rank) as top_tender, max(score) as top_score,
        coalesce(round(sum(case when {_GOING} and taken > 5 then value end), 2), 0.0) as opportunity_cost
        from (select *, sum(case when {_GOING} then 1 else 0 end) over (partition by company order by rank) as taken from best where rank <= 10) group by 1""", _OPEN, _FEATURES, _BEST),
    "opportunity_profile": sql(f"select company, tender, score, urgency as submission_urgency, {_OVERALL} as overall_risk, case when value <> 0 then round(value * win_probability, 2) end as expected_revenue from r", _PART, _FEATURES),
}
