"""Pairs counted in blocks against brute force, with many blocks, and without a shuffle of pairs."""

import os
import random
import re
from collections import Counter
from itertools import product

import duckdb
import pyarrow as pa
import pytest

from bidlattice.operators import company, competitive, executive, opportunity, pairs, relationship, traverse
from bidlattice.plans import catalog, company_queries, schema

from .test_analytics import DATA, graph

X_WEIGHT = schema.WEIGHTS.get("works_with", schema.DEFAULT_WEIGHT)


@pytest.fixture(scope="module")
def edges():
    rnd = random.Random(3)
    out = [(f"TEN-{t}", "issued_by", f"ORG-{rnd.randrange(5)}") for t in range(40)]
    for t in range(40):
        out += [(f"CMP-{c:02}", "submitted_bid" if i else "awarded_to", f"TEN-{t}") for i, c in enumerate(rnd.sample(range(25), rnd.randint(1, 5)))]
    out += [(f"CMP-{c:02}", "in_city", f"CTY-{c % 3}") for c in range(25)] + [(f"CMP-{c:02}", "in_province", "PRV-1") for c in range(25)]
    return out + [("CMP-01", "awarded_to", "TEN-0"), ("CMP-01", "submitted_bid", "TEN-0"), ("CMP-88", "awarded_to", "TEN-99")]


def shared(members):
    """How many keys two companies share, by (company, key) rows."""
    by = {}
    for c, k in set(members):
        by.setdefault(k, set()).add(c)
    return Counter((a, b) for s in by.values() for a, b in product(s, s) if a != b)


def exchanges(df):
    df.count()
    return re.findall(r"hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


def part(edges):
    return {(s, t) for s, k, t in edges if t.startswith("TEN")}


def test_direct_competitors_in_blocks(spark, edges, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 1)
    g = graph(spark, edges)
    buyer = {s: t for s, k, t in edges if k == "issued_by"}
    t, b = shared(part(edges)), shared((c, buyer[x]) for c, x in part(edges) if x in buyer)
    df = competitive.direct_competitors(g, limit=None)
    assert {(r.uid, r.rival): (r.shared_tenders, r.shared_buyers, r.competition_score) for r in df.collect()} == {k: (t[k], b[k], t[k] + b[k] / 2) for k in t | b}
    some = competitive.direct_competitors(g, spark.createDataFrame([("CMP-03",)], "company string"), 2).collect()
    assert [r.rival for r in sorted(some, key=lambda r: (-r.competition_score, r.rival))] == [b_ for _, b_ in sorted(((-t[k] - b[k] / 2, k[1]) for k in t | b if k[0] == "CMP-03"))[:2]]
    assert not any("rival" in x for x in exchanges(df))  # no pair is shuffled


def test_strength_and_shared_in_blocks(spark, edges, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 1)
    more = [*edges, ("CMP-01", "works_with", "CMP-02"), ("CMP-02", "works_with", "CMP-01"), ("CMP-77", "works_with", "CMP-78"), ("CMP-05", "works_with", "CMP-05"), ("CMP-66", "participated_in", "TEN-98"), ("CMP-67", "participated_in", "TEN-98")]
    g = graph(spark, more)
    buyer = {s: t for s, k, t in more if k == "issued_by"}
    on = part(more)
    bidders = {(s, t) for s, k, t in more if k in ("awarded_to", "submitted_bid")}
    tenders, buyers = shared(on), shared((c, buyer[t]) for c, t in bidders if t in buyer)
    places = shared((s, t) for s, k, t in more if k in ("in_city", "in_province"))
    thirds = {}
    for (a, t), (b, u) in product(on, on):
        if a < b and t == u:
            thirds.setdefault((a, b), set()).update(c for c, v in bidders if v == t and c not in (a, b))
    direct = Counter(tuple(sorted((s, t))) for s, k, t in more if k == "works_with")
    df = relationship.strength(g)
    got = {(r.uid_a, r.uid_b): r for r in df.collect()}
    assert set(got) == {p for p in tenders | buyers | places if p[0] < p[1]} | set(direct)
    assert len(got) == df.count()
    for p, r in got.items():
        want = (buyers[p], len(thirds.get(p, ())), 0, places[p], tenders[p], direct[p])
        assert tuple(r)[2:8] == want
        pieces = sorted([X_WEIGHT] * direct[p] + [0.3] * sum(want[:5]), reverse=True)
        assert abs(r.relationship_strength - min(1, sum(w * 0.7**i for i, w in enumerate(pieces)))) < 1e-4
    assert not any("uid_b" in x for x in exchanges(df))  # no pair is shuffled
    assert {(r.uid_a, r.uid_b): r.shared_competitor_count for r in relationship.shared_competitors(g).collect()} == {p: len(c) for p, c in thirds.items() if c}
    inferred = relationship.infer_relationships(g, None).filter("family = 'geographic_cluster_peer'")
    assert {(r.uid, r.other): r.n for r in inferred.collect()} == dict(places)


def test_best_tenders_equal_those_of_all_pairs(spark, edges):
    more = [*edges, *[(f"CMP-{c:02}", "in_industry", f"IND-{c % 4}") for c in range(25)]]
    facts = {f"TEN-{t}": {"value": str(10 ** (t % 8)), "valid_from": f"{2020 + t % 5}-01-01", "closing_date": "2024-07-01" if t % 3 else "2024-01-01"} for t in range(40)}
    g = graph(spark, more, facts)
    got = opportunity.best_opportunities(g, limit=3)
    want = opportunity.best_opportunities(g, opportunity.every_pair(g), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert opportunity._may_lead(g, 3).count() < opportunity.every_pair(g).count()  # not every pair is joined


def met_by_age(edges, years, cutoff):
    """Pairs of edges of two companies on a tender, by (company, rival): since the cutoff, before it, and of no known year."""
    recent, older, undated = Counter(), Counter(), Counter()
    on = [(s, t) for s, k, t in edges if t.startswith("TEN")]
    for (a, t), (b, u) in product(on, on):
        if t == u and a != b:
            y = years.get(t)
            (undated if y is None else recent if y >= cutoff else older)[a, b] += 1
    return recent, older, undated


def test_emerging_and_market_position_in_blocks(spark, edges, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 1)
    years = {f"TEN-{t}": 2018 + t % 7 for t in range(40) if t % 9}
    g = graph(spark, edges, {t: {"valid_from": f"{y}-02-01"} for t, y in years.items()})
    recent, older, undated = met_by_age(edges, years, 2022)
    new = {p for p in recent if recent[p] > older[p]}
    df = competitive.emerging_competitors(g, limit=None)
    assert {(r.uid, r.rival): (r.recent_appearances, r.older_appearances) for r in df.collect()} == {p: (recent[p], older[p]) for p in new}
    some = competitive.emerging_competitors(g, spark.createDataFrame([("CMP-03",)], "company string"), limit=None).collect()
    assert {r.rival for r in some} == {b for a, b in new if a == "CMP-03"}
    met = {*recent, *older, *undated}
    buyer = {s: t for s, k, t in edges if k == "issued_by"}
    direct = met | set(shared((c, buyer[x]) for c, x in part(edges) if x in buyer))
    n = lambda ps, uid: sum(a == uid for a, _ in ps)
    position = executive.market_position(g)
    got = {r.uid: (r.direct_competitors, r.emerging_threats) for r in position.collect()}
    assert got == {u: (min(5, n(direct, u)), min(3, n(new, u))) for u in got} and len(got) == 26
    assert {r.uid: r.unique_competitors for r in competitive.competitive_pressure(g).collect()} == {u: n(met, u) for u in got}
    for f in (df, position, competitive.competitive_pressure(g), executive.risk_register(g)):
        assert not any("rival" in x for x in exchanges(f))  # no pair is shuffled


def test_counts_up_to_a_limit_by_parts_of_the_others(spark, edges, monkeypatch):
    monkeypatch.setattr(competitive, "SPARE", 1)  # 26 companies: parts of an eighth and more come before all
    years = {f"TEN-{t}": 2018 + t % 7 for t in range(40) if t % 9}
    g = graph(spark, edges, {t: {"valid_from": f"{y}-02-01"} for t, y in years.items()})
    recent, older, undated = met_by_age(edges, years, 2022)
    new, met, buyer = {p for p in recent if recent[p] > older[p]}, {*recent, *older, *undated}, {s: t for s, k, t in edges if k == "issued_by"}
    direct = met | set(shared((c, buyer[x]) for c, x in part(edges) if x in buyer))
    looked = []
    whole = competitive.counted
    monkeypatch.setattr(competitive, "counted", lambda kinds: looked.append(1) or whole(kinds))
    companies = [r.uid for r in g.names("company").collect()]
    for limit in (1, 3, 12):
        some = competitive.rivals_up_to(g, limit)
        for df, pairs_ in ((some, met), (competitive.direct_up_to(g, limit, some), direct), (competitive.emerging_up_to(g, limit), new)):
            got = df.collect()
            assert len({r[0] for r in got}) == len(got)
            assert {c: 0 for c in companies} | dict(map(tuple, got)) == {c: min(limit, sum(a == c for a, _ in pairs_)) for c in companies}
    assert len(looked) > 9  # several parts
    buyers = {c: {buyer[t] for x, t in part(edges) if x == c and t in buyer} for c in companies}
    single = {r.uid for r in company.single_buyer(g).filter("single_buyer").collect()}
    assert single == {c for c, b in buyers.items() if len(b) == 1} == {r.uid for r in company.buyers(g).groupBy("uid").count().filter("count = 1").collect()}
    assert {r.uid: r.bid_count for r in company.bid_counts(g).collect()} == {r.uid: r.n for r in company.summary(g).selectExpr("uid", "tenders_won + tenders_submitted as n").filter("n > 0").collect()}


def test_related_companies_in_blocks(spark, edges, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 1)
    more = [*edges, ("CMP-01", "works_with", "CMP-02"), ("CMP-02", "works_with", "CMP-01"), ("CMP-77", "works_with", "CMP-78"), ("CMP-05", "works_with", "CMP-05")]
    links = Counter(shared((s, t) for s, k, t in more if s.startswith("CMP") and not t.startswith("CMP")))
    links.update({p for s, k, t in more if s.startswith("CMP") and t.startswith("CMP") for p in ((s, t), (t, s))})
    df = traverse.related_companies(graph(spark, more), limit=4)
    want = {a: sorted((-n, b) for (c, b), n in links.items() if c == a)[:4] for a, _ in links}
    got = {}
    for r in df.collect():
        got.setdefault(r.uid, []).append((-r.links, r.other))
    assert {a: sorted(x) for a, x in got.items()} == want
    assert not any("other" in x and "uid" in x for x in exchanges(df))  # pairs stay in their task
    some = traverse.related_companies(graph(spark, more), spark.createDataFrame([("CMP-02",)], "uid string"), 4)
    assert sorted((-r.links, r.other) for r in some.collect()) == want["CMP-02"]


def test_relationship_map_in_blocks(spark, edges, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 1)
    g = graph(spark, edges)
    lonely = graph(spark, [e for e in edges if e[1] not in ("in_city", "in_province")])
    for at in (g, lonely):
        links = Counter(r.uid for r in relationship.infer_relationships(at, 10).collect())
        want = {r.uid: min(10, links[r.uid]) for r in at.names("company").collect()}
        partners = Counter(r.uid for r in relationship.recurring_partnerships(at, 1, 10).collect())
        df = executive.relationship_map(at)
        assert {r.uid: (r.partner_count, r.inferred_count) for r in df.collect()} == {u: (partners[u], n) for u, n in want.items()}
        for limit in (2, 40):
            links = Counter(r.uid for r in relationship.infer_relationships(at, limit).collect())
            assert {r.uid: r.inferred_count for r in relationship.inferred_count(at, limit).collect()} == {u: min(limit, links[u]) for u in want}
        assert not any("uid" in x and "other" in x for x in exchanges(relationship.partner_count(at, 10)))  # no pair is shuffled


def test_scores_shuffle_no_sets_and_profiles_score_once(spark, edges):
    more = [*edges, *[(f"CMP-{c:02}", "in_industry", f"IND-{c % 4}") for c in range(3, 25)]]  # some have no industry
    g = graph(spark, more, {f"TEN-{t}": {"value": str(10 ** (t % 8)), "valid_from": "2023-01-01", "closing_date": "2024-07-01"} for t in range(40)})
    own = opportunity.taking_part(g)
    columns = ["company", "tender", *opportunity.WEIGHTS, "score"]
    df = opportunity.score(g, own).select(columns)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, opportunity.score(g, own.filter("tender is not null")).select(columns).collect()))
    lucky = opportunity.score(g, own.join(g.industries.select("company").distinct(), "company", "left_semi")).select(columns)
    assert {r.industry_history for r in df.filter("company in ('CMP-01', 'CMP-02')").collect()} != {0.3}  # these look their histories up
    assert set(map(tuple, lucky.collect())) < set(map(tuple, df.collect()))
    whole = graph(spark, [*edges, *[(f"CMP-{c:02}", "in_industry", f"IND-{c % 4}") for c in (*range(25), 88)]])
    assert not any("inds" in x for x in exchanges(opportunity.score(whole, opportunity.taking_part(whole))))  # sets of industries are no keys of a shuffle
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(opportunity.profile(g, own)) == joins(opportunity.score(g, own))


@pytest.mark.parametrize("side", [4, 2_048])
def test_competitors_shared_by_pairs_that_never_met(spark, edges, monkeypatch, side):
    monkeypatch.setattr(pairs, "SIDE", side)
    monkeypatch.setattr(pairs, "COLUMNS", 3 if side == 4 else 4_096)
    more = [*edges, ("CMP-66", "participated_in", "TEN-98"), ("CMP-67", "participated_in", "TEN-98"), ("CMP-88", "submitted_bid", "TEN-1"), ("CMP-90", "participated_in", "TEN-2"), ("CMP-67", "in_province", "PRV-1"), ("CMP-66", "works_with", "CMP-67")]
    g, on = graph(spark, more), part(more)
    bidders = {(s, t) for s, k, t in more if k in ("awarded_to", "submitted_bid")}
    of, third, met = {}, {}, {}
    for c, t in on:
        of.setdefault(c, set()).add(t)
    for c, t in bidders:
        third.setdefault(t, set()).add(c)
    met = {c: {x for t in ts for x in third.get(t, ())} - {c} for c, ts in of.items()}
    want, far = {}, 0
    for a, b in product(of, of):
        if a < b:
            common = of[a] & of[b]
            n = len({x for t in common for x in third.get(t, ())} - {a, b}) if common else len(met[a] & met[b])
            far += bool(n and not common)
            want |= {(a, b): n} if n else {}
    assert far > 5
    assert {(r.uid_a, r.uid_b): r.shared_competitor_count for r in relationship.shared_competitors(g, far=True).collect()} == want
    df = relationship.strength(g, far=True)
    got = {(r.uid_a, r.uid_b): r for r in df.collect()}
    plain = {(r.uid_a, r.uid_b): r for r in relationship.strength(g).collect()}
    assert len(got) == df.count() and set(got) == set(plain) | set(want)
    assert {p: r.shared_competitor_count for p, r in got.items() if r.shared_competitor_count} == want
    others = ("shared_buyer_count", "shared_industry_count", "shared_location_count", "co_appearances", "direct_count")
    assert all(tuple(got[p][c] for c in others) == tuple(r[c] for c in others) for p, r in plain.items())
    given = spark.createDataFrame(list(want), "uid_a string, uid_b string")
    assert {(r.uid_a, r.uid_b): r for r in relationship.strength(g, given).collect()} == {p: got[p] for p in want}
    assert not any("uid_b" in x for x in exchanges(df))  # no pair is shuffled


@pytest.mark.parametrize("name", ["shared_competitors", "relationship_strength", "relationship_explain"])
def test_registered_queries_and_sql_have_pairs_that_never_met(spark, name):
    on = [(0, 0), (0, 2), (1, 1), (1, 2)]  # (order, supplier): suppliers 0 and 1 both meet 2, and never each other
    g = graph(spark, [(f"CMP-{s + 1:08}", "submitted_bid" if s == 2 else "awarded_to", f"TEN-{o + 1:08}") for o, s in on])
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create table {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'" + (" limit 0" if f.startswith(("supplier", "orders", "part.")) else ""))
    c.sql(f"create or replace table lineitem as select * exclude (o, s) replace (o as l_orderkey, s as l_suppkey, -s as l_extendedprice) from lineitem cross join (values {', '.join(map(str, on))}) v(o, s) qualify row_number() over (partition by o, s) = 1")
    rows = company_queries.QUERIES[name](g).collect()
    want = {(r[0], r[1]) for r in c.sql(catalog.ORACLES[name]).fetchall()}
    assert {(r.uid_a, r.uid_b) for r in rows} == want and ("CMP-00000001", "CMP-00000002") in want


@pytest.mark.parametrize("cells", [0, 50_000_000])
def test_blocks_of_one_partition_are_counted_one_by_one(monkeypatch, cells):
    monkeypatch.setattr(pairs, "CELLS", cells)
    rnd = random.Random(5)
    n, blocks, limit = 40, 8, 3
    keys = [(kind, sorted(rnd.sample(range(n), 6))) for kind in (0, 1) for _ in range(60)]
    rows = sorted(((kind, [c for c in x if c * blocks // n == b], x, [], b) for kind, x in keys for b in range(blocks) if any(c * blocks // n == b for c in x)), key=lambda r: r[4])
    types = [pa.int32(), *[pa.list_(pa.int32())] * 3, pa.int32()]
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 7]), types)], list("kfstb")) for i in range(0, len(rows), 7)]
    held = []
    for kept in (pairs._Sorted, pairs._Dense):
        monkeypatch.setattr(kept, "result", lambda self, whole=kept.result: held.append(1) or whole(self))
    got = [r for b in pairs._counter(["tenders", "buyers"], None, False, ({"tenders": 2, "buyers": 1}, limit), n, blocks)(batches) for r in b.to_pylist()]
    t, b = (shared((c, i) for i, (k, x) in enumerate(keys) if k == kind for c in x) for kind in (0, 1))
    want = {p for a in range(n) for p in sorted((p for p in t | b if p[0] == a), key=lambda p: (-2 * t[p] - b[p], p))[:limit]}
    assert {(r["a"], r["b"]): (r["tenders"], r["buyers"]) for r in got} == {p: (t[p], b[p]) for p in want} and len(got) == len(want)
    assert len(held) == blocks  # each block's counts go before the next one's come
