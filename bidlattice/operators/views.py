"""The graph and the views that all analytics are expressed over."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans import schema
from ..session import stored


def view(f: Callable) -> cached_property:
    """A view of a graph: made once, and stored where the graph is kept."""
    return cached_property(lambda self: self.once(f.__name__, lambda: f(self)))


class Graph:
    """Entities and relations, with ``as_of`` as today's date of every date-relative operator.

    ``normalise``: award edges written tender to company are turned round and repeated ones dropped. Views are lazy;
    a filter on a kind reaches the scan of the tables, so each view reads only the edges it needs. ``kept``: a view is
    written to the shared folder when it is first used, and every operator that uses it again reads that."""

    def __init__(self, entities: DataFrame, relations: DataFrame, as_of: str, normalise: bool = False, kept: bool = False):
        self.entities, self.relations, self.as_of, self.normalise, self.kept = entities, relations, as_of, normalise, kept
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, made once; stored where the graph is kept."""
        if name not in self._made:
            self._made[name] = stored(make(), name) if self.kept else make()
        return self._made[name]

    def nodes(self, *kinds: str) -> DataFrame:
        return self.entities.filter(F.col("kind").isin(*kinds))

    def edges(self, *kinds: str) -> DataFrame:
        return self.relations.filter(F.col("kind").isin(*kinds))

    def names(self, *kinds: str) -> DataFrame:
        return self.nodes(*kinds).select("uid", "name")

    @view
    def participation(self) -> DataFrame:
        """(company, tender, role, is_win, contract_value): a row for each edge by which a company takes part."""
        edges = self.edges(*schema.BIDS)
        forward = edges.filter(X.is_kind("source_uid", "company") & X.is_kind("target_uid", "tender"))
        columns = lambda a, b: [F.col(a).alias("company"), F.col(b).alias("tender"), F.col("kind").alias("role"), F.col("attributes")["contract_value"].alias("contract_value")]
        out = forward.select(*columns("source_uid", "target_uid"))
        if self.normalise:
            back = edges.filter((F.col("kind") == "awarded_to") & X.is_kind("source_uid", "tender") & X.is_kind("target_uid", "company"))
            out = out.unionByName(back.select(*columns("target_uid", "source_uid"))).groupBy("company", "tender", "role").agg(F.max("contract_value").alias("contract_value"))
        return out.withColumn("is_win", F.col("role") == "awarded_to")

    @view
    def issued(self) -> DataFrame:
        """(tender, buyer): every issuing edge to an organisation or company."""
        edges = self.edges("issued_by").filter(X.is_kind("source_uid", "tender") & X.is_kind("target_uid", "organization", "company"))
        return edges.select(F.col("source_uid").alias("tender"), F.col("target_uid").alias("buyer"))

    @view
    def buyer_of(self) -> DataFrame:
        """(tender, buyer): one buyer of each tender, the smallest uid."""
        return self.issued.groupBy("tender").agg(F.min("buyer").alias("buyer"))

    @view
    def winner_of(self) -> DataFrame:
        """(tender, winner): one winner of each tender, the smallest uid."""
        return self.participation.filter("is_win").groupBy("tender").agg(F.min("company").alias("winner"))

    @view
    def facts(self) -> DataFrame:
        """(tender, name, value, date, deadline, buyer-engine date and value, city, province, category) of each tender."""
        a = F.col("attributes")
        dated = X.first_truthy(a, "valid_from", "date")
        return self.nodes("tender").select(
            F.col("uid").alias("tender"), F.col("name").alias("tender_name"),
            F.coalesce(*[X.number(a[k]) for k in schema.VALUE_KEYS]).alias("value"),
            X.first_truthy(a, *schema.DATE_KEYS).alias("date"), X.first_truthy(a, *schema.DEADLINE_KEYS).alias("deadline"),
            X.number(X.first_truthy(a, "value", "contract_value", "estimated_value")).alias("issue_value"),
            X.year(dated).alias("issue_year"), X.month(dated).alias("issue_month"),
            X.money(X.first_truthy(a, "contract_value", "estimated_value")).alias("award_value"),
            X.year(X.first_truthy(a, "valid_from", "date", "award_date")).alias("activity_year"),
            F.lower(F.coalesce(a["city"], F.lit(""))).alias("city"), F.lower(F.coalesce(a["province"], F.lit(""))).alias("province"),
            a["category"].alias("category"),
        )

    def _out(self, name: str, kind: str, node: str) -> DataFrame:
        edges = self.edges(kind).filter(X.is_kind("source_uid", "company") & X.is_kind("target_uid", node))
        return edges.select(F.col("source_uid").alias("company"), F.col("target_uid").alias(name)).distinct()

    @view
    def industries(self) -> DataFrame:
        return self._out("industry", "in_industry", "industry")

    @view
    def cities(self) -> DataFrame:
        return self._out("city", "in_city", "city")

    @view
    def provinces(self) -> DataFrame:
        return self._out("province", "in_province", "province")

    @view
    def locations(self) -> DataFrame:
        """(company, location, location_kind)."""
        edges = self.edges("in_city", "in_province", "located_at", "has_address").filter(X.is_kind("source_uid", "company"))
        return edges.select(F.col("source_uid").alias("company"), F.col("target_uid").alias("location"), F.col("kind").alias("relation")).distinct()

    @view
    def adjacency(self) -> DataFrame:
        """(uid, other, relation, direction, weight): each edge from both of its ends."""
        r = self.relations
        w = X.weight("kind")
        out = r.select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("other"), F.col("kind").alias("relation"), F.lit("out").alias("direction"), w.alias("weight"), "valid_to")
        back = r.select(F.col("target_uid").alias("uid"), F.col("source_uid").alias("other"), F.col("kind").alias("relation"), F.lit("in").alias("direction"), w.alias("weight"), "valid_to")
        return out.unionByName(back)

    @view
    def scopes(self) -> DataFrame:
        """(scope, tender): a market scope's tenders: a buyer's issued, or those companies of a city, province or industry take part in."""
        taking = self.participation.select("company", "tender").distinct()
        out = self.issued.filter(X.is_kind("buyer", "organization")).select(F.col("buyer").alias("scope"), "tender")
        for members, key in ((self.cities, "city"), (self.provinces, "province"), (self.industries, "industry")):
            out = out.unionByName(members.join(taking, "company").select(F.col(key).alias("scope"), "tender").distinct())
        return out

    @view
    def scope_wins(self) -> DataFrame:
        """(scope, company, wins): a buyer's awards by winner; a city's, province's or industry's companies by all their awards."""
        out = self.issued.filter(X.is_kind("buyer", "organization")).join(self.winner_of, "tender").groupBy(F.col("buyer").alias("scope"), F.col("winner").alias("company")).agg(F.count("*").alias("wins"))
        won = self.participation.filter("is_win").groupBy("company").agg(F.count("*").alias("wins"))
        for members, key in ((self.cities, "city"), (self.provinces, "province"), (self.industries, "industry")):
            out = out.unionByName(members.join(won, "company").select(F.col(key).alias("scope"), "company", "wins"))
        return out
