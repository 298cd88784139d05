"""DuckDB SQL that computes the registered queries from the star-schema tables alone."""

from __future__ import annotations

import re

#: Views of the graph over the tables, as common table expressions.
VIEWS = r"""
ranked as (select l_orderkey, l_suppkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_suppkey, l_partkey, l_linenumber, l_quantity) as k from lineitem),
tp as (
  select printf('CMP-%08d', l_suppkey + 1) as company, printf('TEN-%08d', l_orderkey + 1) as tender, max(k = 1) as is_win, max(case when k = 1 then l_extendedprice end) as cv
  from ranked group by l_suppkey, l_orderkey),
tb as (select printf('TEN-%08d', o_orderkey + 1) as tender, printf('ORG-%08d', o_custkey + 1) as buyer from orders),
tw as (select tender, company as winner from tp where is_win),
tf as (
  select printf('TEN-%08d', o_orderkey + 1) as tender, o_totalprice as value, year(o_orderdate)::int as y, month(o_orderdate)::int as m,
    cast(o_orderdate as date) as d, cast(o_orderdate as date) + 45 as closing, o_orderpriority as category
  from orders),
brand_n as (select l_suppkey, p_brand, count(*) as n from lineitem join part on p_partkey = l_partkey group by all),
ci as (select printf('CMP-%08d', l_suppkey + 1) as company, 'IND-' || lpad(regexp_extract(p_brand, '(\d+)$', 1), 8, '0') as industry, p_brand as industry_name
  from (select *, row_number() over (partition by l_suppkey order by n desc, p_brand) as k from brand_n) where k = 1),
home as (select printf('CMP-%08d', s_suppkey + 1) as company, s_name as name, printf('CTY-%08d', n_nationkey + 1) as city, n_name as city_name, printf('PRV-%08d', r_regionkey + 1) as province, r_name as province_name
  from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey),
org as (select printf('ORG-%08d', c_custkey + 1) as buyer, c_name as name, n_name as city_name, r_name as province_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
aw as (select buyer, winner as supplier, count(*) as n from tb join tw using (tender) group by all),
scopes as (
  select buyer as scope, tender from tb
  union all select distinct city, tender from home join tp using (company)
  union all select distinct province, tender from home join tp using (company)
  union all select distinct industry, tender from ci join tp using (company)),
won as (select company, count(*) as wins from tp where is_win group by 1),
scope_wins as (
  select buyer as scope, supplier as company, n as wins from aw
  union all select city, company, wins from home join won using (company)
  union all select province, company, wins from home join won using (company)
  union all select industry, company, wins from ci join won using (company))
"""


def _rounded(text: str) -> str:
    """``round(x, n)`` as half up with ties a millionth of the last digit wide, as the Spark side has it."""
    at = re.search(r"(?<![\w])round\(", text)
    if not at:
        return text
    depth, comma, i = 1, None, at.end()
    while depth:
        c = text[i]
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 1:
            comma = i
        i += 1
    inner, digits = _rounded(text[at.end() : comma]), int(text[comma + 1 : i - 1])
    return f"{text[: at.start()]}(floor(({inner})::double * 1e{digits}::double + 0.500001::double) / 1e{digits}::double){_rounded(text[i:])}"


def sql(body: str, *more: str) -> str:
    """A query over the views; ``more``: further table expressions."""
    return _rounded("with " + ",\n".join([VIEWS.strip(), *[m.strip() for m in more]]) + "\n" + body.strip())


def confidence(n: str) -> str:
    return f"round(least(1.0, 0.3::double + 0.07::double * least(10, {n})), 4)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(round(({a})::double / nullif({b}, 0)::double, 4), 0.0)"


def hhi(n: str) -> str:
    return f"coalesce(round(sum({n}::double * {n}::double) / pow(sum({n}::double), 2.0), 4), 0.0)"


def level(h: str) -> str:
    return f"case when {h} >= 0.25 then 'highly_concentrated' when {h} >= 0.15 then 'moderately_concentrated' else 'competitive' end"
