"""Registered buyer queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buyer
from .oracles import confidence, hhi, level, ratio, sql

QUERIES = {
    "buyer_summary": buyer.summary,
    "buyer_supplier_roster": buyer.supplier_roster,
    "buyer_preferred_suppliers": buyer.preferred_suppliers,
    "buyer_supplier_loyalty": buyer.supplier_loyalty,
    "buyer_supplier_diversity": buyer.supplier_diversity,
    "buyer_buying_patterns": buyer.buying_patterns,
    "buyer_procurement_seasonality": buyer.procurement_seasonality,
    "buyer_preferred_industries": buyer.preferred_industries,
    "buyer_preferred_contract_sizes": buyer.preferred_contract_sizes,
    "buyer_avg_procurement_value": buyer.avg_procurement_value,
    "buyer_avg_bidder_count": buyer.avg_bidder_count,
    "buyer_award_concentration": lambda g: buyer.award_concentration(g).withColumn("top_supplier", F.col("top_suppliers")[0].uid).drop("top_suppliers"),
    "buyer_competitiveness": buyer.buyer_competitiveness,
    "buyer_timeline": buyer.buyer_timeline,
    "buyer_tender_forecast": buyer.tender_forecast,
    "buyer_calendar": buyer.calendar,
    "buyer_profile": lambda g: buyer.profile(g).select("uid", "summary.total_tenders", "patterns.busiest_year", "value.median_value", "concentration.hhi", "competitiveness.competitiveness_level", "forecast.forecast_basis"),
}

_TOTALS = "totals as (select buyer, count(*) as total_tenders from tb group by 1)"
_CONC = f"conc as (select buyer, cast(sum(n) as bigint) as total_awards, count(*) as unique_suppliers, {hhi('n')} as hhi from aw group by 1)"
_DIV = f"""div as (select buyer as uid, coalesce(total_awards, 0) as total_awards, coalesce(unique_suppliers, 0) as unique_suppliers, coalesce(hhi, 0.0) as award_hhi, round(1 - coalesce(hhi, 0.0), 4) as diversity_score
  from totals left join conc using (buyer))"""
_BIDDERS = "bidders as (select buyer, tender, coalesce(n, 0) as n from tb left join (select tender, count(*) as n from tp group by 1) using (tender))"
_BID = f"""bid as (select buyer as uid, count(*) as total_tenders, round(avg(n), 2) as avg_bidder_count, min(n) as min_bidder_count, max(n) as max_bidder_count, count(*) filter (n <= 1) as single_bidder_tenders,
  {ratio("count(*) filter (n <= 1)", "count(*)")} as single_bidder_rate from bidders group by 1)"""
_ISSUED = "issued as (select * from tb join tf using (tender))"
_ROSTER = f"""roster as (select buyer as uid, company as supplier, count(*) filter (is_win) as award_count, count(*) as bid_count, {ratio("count(*) filter (is_win)", "count(*)")} as win_rate, {confidence("count(*) filter (is_win)")} as confidence
  from tb join tp using (tender) group by buyer, company)"""
_BUCKETS = "(values (0, 'micro', 0, 10000), (1, 'small', 10000, 100000), (2, 'medium', 100000, 1000000), (3, 'large', 1000000, 10000000), (4, 'mega', 10000000, 1e300)) b(k, bucket, lo, hi)"
_COMP = f"""comp as (select uid, round(0.4::double * least(1.0, avg_bidder_count / 5.0) + 0.3::double * diversity_score + 0.3::double * (1 - single_bidder_rate), 4) as s, round(least(1.0, avg_bidder_count / 5.0), 4) as a, diversity_score, round(1 - single_bidder_rate, 4) as o from bid join div using (uid))"""
_LEVEL = "case when s >= 0.65 then 'highly_competitive' when s >= 0.4 then 'moderately_competitive' else 'low_competition' end"
_FORECAST = """f as (select buyer as uid, count(*) as total_tenders, count(*) as tenders_with_dates, max(y * 12 + m) as last, min(y * 12 + m) as first, count(distinct y * 12 + m) as months from issued group by 1),
fc as (select *, case when months > 1 then round((last - first) / (months - 1)::double, 1) end as cadence from f)"""

ORACLES = {
    "buyer_calendar": sql(
        f"""select buyer as uid, y as year, q as quarter, m as month, ['month', 'quarter', '', 'year', '', '', '', 'all'][id + 1] as level, n as "count", {ratio("n", "total")} as share
        from (select *, case id when 0 then sum(n) filter (id = 0) over (partition by buyer, y, q) when 1 then sum(n) filter (id = 0) over (partition by buyer, y) else sum(n) filter (id = 0) over (partition by buyer) end as total
          from (select buyer, y, q, m, grouping(y, q, m) as id, count(*) as n from (select buyer, y, ((m + 2) // 3)::int as q, m from issued) group by buyer, rollup (y, q, m)))""", _ISSUED),
    "buyer_summary": sql(
        f"""select buyer as uid, name, total_tenders, coalesce(active, 0) as active_suppliers, coalesce(h, 0.0) as award_hhi, top_supplier, top_n as top_supplier_awards, {confidence("total_tenders")} as confidence
        from org join totals using (buyer) left join (select buyer, count(*) as active, {hhi("n")} as h from aw group by 1) using (buyer)
        left join (select buyer, supplier as top_supplier, n as top_n from (select *, row_number() over (partition by buyer order by n desc, supplier) as k from aw) where k = 1) using (buyer)""", _TOTALS),
    "buyer_supplier_roster": sql("select * from roster", _ROSTER),
    "buyer_preferred_suppliers": sql("select * from roster where award_count >= 2", _ROSTER),
    "buyer_supplier_loyalty": sql(
        f"""select buyer as uid, supplier, n as award_count, {ratio("n", "total_tenders")} as loyalty_index, round(sqrt(hhi), 4) as overall_loyalty_score,
        case when round(sqrt(hhi), 4) >= 0.5 then 'high' when round(sqrt(hhi), 4) >= 0.25 then 'medium' else 'low' end as loyalty_interpretation, {confidence("n")} as confidence
        from aw join totals using (buyer) join conc using (buyer)""", _TOTALS, _CONC),
    "buyer_supplier_diversity": sql("select *, case when diversity_score >= 0.75 then 'high' when diversity_score >= 0.5 then 'medium' when diversity_score >= 0.25 then 'low' else 'very_low' end as diversity_level from div", _TOTALS, _CONC, _DIV),
    "buyer_buying_patterns": sql(
        """select buyer as uid, total_tenders, avg_value, avg_bidder_count, pm.m as peak_month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][pm.m] as peak_month_name, py.y as busiest_year,
        case when total_tenders >= 2 and last_year > first_year then round((last_year - first_year) * 12 / (total_tenders - 1)::double, 1) end as cadence_months, last_year - first_year as year_span, first_year, last_year
        from (select buyer, count(*) as total_tenders, round(avg(value), 2) as avg_value, min(y) as first_year, max(y) as last_year from issued group by 1)
        join (select buyer, round(avg(n), 2) as avg_bidder_count from bidders group by 1) using (buyer)
        join (select buyer, m from (select buyer, m, row_number() over (partition by buyer order by count(*) desc, m) as k from issued group by buyer, m) where k = 1) pm using (buyer)
        join (select buyer, y from (select buyer, y, row_number() over (partition by buyer order by count(*) desc, y) as k from issued group by buyer, y) where k = 1) py using (buyer)""", _ISSUED, _BIDDERS),
    "buyer_procurement_seasonality": sql(
        f"""select buyer as uid, m as month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][m] as month_name, n as "count", {ratio("n", "total")} as share,
        coalesce(round((n - total / 12::double) / nullif(total / 12::double, 0), 4), 0.0) as seasonality_index, q as quarter, qn as quarter_count, {ratio("qn", "total")} as quarter_share, pk = 1 as is_peak_month
        from (select *, cast(sum(n) over (partition by buyer) as bigint) as total, cast(sum(n) over (partition by buyer, q) as bigint) as qn, row_number() over (partition by buyer order by n desc, m) as pk
          from (select buyer, g.m::int as m, ((g.m - 1) // 3 + 1)::int as q, count(i.m) as n from (select distinct buyer from tb) cross join range(1, 13) g(m) left join issued i using (buyer, m) group by all))""", _ISSUED),
    "buyer_preferred_industries": sql(
        f"""select buyer as uid, industry, n as "count", {ratio("n", "sum(n) over (partition by buyer)")} as share, {confidence("n")} as confidence
        from (select buyer, industry, count(*) as n from tb join tp using (tender) join ci using (company) group by all)""", ),
    "buyer_preferred_contract_sizes": sql(
        f"""select buyer as uid, bucket, n as "count", {ratio("n", "total")} as share, pk = 1 as is_preferred, total as tenders_with_value, avg_value, min_value, max_value
        from (select *, cast(sum(n) over (partition by buyer) as bigint) as total, row_number() over (partition by buyer order by n desc, k) as pk
          from (select x.buyer, b.k, b.bucket, count(i.value) as n from (select distinct buyer from tb) x cross join {_BUCKETS} left join issued i on i.buyer = x.buyer and i.value >= lo and i.value < hi group by all))
        join (select buyer, round(avg(value), 2) as avg_value, min(value) as min_value, max(value) as max_value from issued group by 1) using (buyer)""", _ISSUED),
    "buyer_avg_procurement_value": sql("select buyer as uid, count(value) as tenders_with_value, round(avg(value), 2) as avg_value, round(median(value), 2) as median_value, min(value) as min_value, max(value) as max_value, round(sum(value), 2) as total_value from issued group by 1", _ISSUED),
    "buyer_avg_bidder_count": sql("select * from bid", _BIDDERS, _BID),
    "buyer_award_concentration": sql(
        f"""select buyer as uid, total_awards, unique_suppliers, hhi, {level("hhi")} as concentration_level, supplier as top_supplier from conc
        join (select buyer, supplier from (select *, row_number() over (partition by buyer order by n desc, supplier) as k from aw) where k = 1) using (buyer)""", _CONC),
    "buyer_competitiveness": sql(f"select uid, s as competitiveness_score, {_LEVEL} as competitiveness_level, a as avg_bidder_score, diversity_score, o as open_tender_score from comp", _TOTALS, _CONC, _DIV, _BIDDERS, _BID, _COMP),
    "buyer_timeline": sql(
        """select buyer as uid, y as year, tender_count, coalesce(unique_suppliers, 0) as unique_suppliers, coalesce(unique_winners, 0) as unique_winners, total_value, avg_value, top_winner,
        case when prior is null then 'insufficient_data' when last > prior * 1.2::double then 'growing' when last < prior * 0.8::double then 'declining' else 'stable' end as trend
        from (select *, first_value(tender_count) over w as last, nth_value(tender_count, 2) over w as prior
          from (select buyer, y, count(*) as tender_count, round(sum(value), 2) as total_value, round(avg(value), 2) as avg_value from issued group by 1, 2)
          window w as (partition by buyer order by y desc rows between unbounded preceding and unbounded following))
        left join (select buyer, y, count(distinct company) as unique_suppliers, count(distinct case when is_win then company end) as unique_winners from issued join tp using (tender) group by 1, 2) using (buyer, y)
        left join (select buyer, y, winner as top_winner from (select buyer, y, winner, row_number() over (partition by buyer, y order by count(*) desc, winner) as k from issued join tw using (tender) group by 1, 2, 3) where k = 1) using (buyer, y)""", _ISSUED),
    "buyer_tender_forecast": sql(
        """select uid, total_tenders, tenders_with_dates, case when cadence > 0 then round(least(1.0, (2001 * 12 + 8 - last) / cadence), 4) else 0.5 end as forecast_probability,
        case when cadence > 0 then 'cadence_model' else 'base_rate' end as forecast_basis, cadence as cadence_months, ((last - 1) // 12)::int as last_tender_year, ((last - 1) % 12 + 1)::int as last_tender_month,
        (2001 * 12 + 8 - last)::int as months_since_last, ((last + round_even(cadence, 0)::int - 1) // 12)::int as estimated_next_year, ((last + round_even(cadence, 0)::int - 1) % 12 + 1)::int as estimated_next_month from fc""", _ISSUED, _FORECAST),
    "buyer_profile": sql(
        f"""select uid, total_tenders, y as busiest_year, median_value, hhi, {_LEVEL} as competitiveness_level, case when cadence > 0 then 'cadence_model' else 'base_rate' end as forecast_basis
        from fc join comp using (uid) left join (select buyer as uid, hhi from conc) using (uid) join (select buyer as uid, round(median(value), 2) as median_value from issued group by 1) using (uid)
        join (select buyer as uid, y from (select buyer, y, row_number() over (partition by buyer order by count(*) desc, y) as k from issued group by buyer, y) where k = 1) using (uid)""", _ISSUED, _TOTALS, _CONC, _DIV, _BIDDERS, _BID, _COMP, _FORECAST),
}
