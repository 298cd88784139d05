"""Registered queries of the graph engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.views import Graph
from ..sources import star
from . import buyer_queries, company_queries, competitive_queries, graph_queries, opportunity_queries, store_queries

FLAGSHIP = "market_share"


def _on_star(query: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(star.kept(spark, folder))


_PARTS = (buyer_queries, competitive_queries, opportunity_queries, company_queries)
_GRAPH = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _on_star(query) for name, query in _GRAPH.items()} | graph_queries.QUERIES | store_queries.QUERIES
ORACLES: dict[str, str] = {name: text for part in _PARTS for name, text in part.ORACLES.items()} | graph_queries.ORACLES | store_queries.ORACLES
