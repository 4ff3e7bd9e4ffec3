"""Queries over the test tables by name, with SQL for DuckDB where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stridemap.plans import road_queries, scalar_queries, transit_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**transit_queries.QUERIES, **road_queries.QUERIES, **scalar_queries.QUERIES}
ORACLES: dict[str, str] = {**transit_queries.ORACLES, **road_queries.ORACLES, **scalar_queries.ORACLES}
