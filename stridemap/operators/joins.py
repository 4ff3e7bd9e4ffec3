"""Joins that Catalyst has no plan for: within a distance, and the first row at or after a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemap.functions.geo import cell, squared_distance


def pairs_within(points: DataFrame, radius: int, key: str = "stop") -> DataFrame:
    """(a, b, d2) for all ordered pairs of different points at most `radius` apart.

    Points lie in square cells as wide as the radius, so a partner is in the same cell or one
    of the eight around it: one side is repeated for nine cells, and the join is by equality of cells. Points
    without coordinates have no partners.
    """
    placed = points.where("easting is not null and northing is not null").select(F.col(key).alias("a"), F.col("easting").alias("e"), F.col("northing").alias("n"))
    here = placed.withColumns({"cx": cell(F.col("e"), radius), "cy": cell(F.col("n"), radius)})
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    there = here.select(F.col("a").alias("b"), F.col("e").alias("e2"), F.col("n").alias("n2"), "cx", "cy", F.explode(around).alias("o"))
    there = there.select("b", "e2", "n2", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    d2 = squared_distance(F.col("e"), F.col("n"), F.col("e2"), F.col("n2"))
    return here.join(there, ["cx", "cy"]).select("a", "b", d2.alias("d2")).where((F.col("a") != F.col("b")) & (F.col("d2") <= radius * radius))


def first_at_or_after(sorted_values: Column, value: Column) -> Column:
    """Index of the first element of an ascending array that is not below value; the size if there is none."""
    return F.size(F.filter(sorted_values, lambda x: x < value))


def asof_first(left: DataFrame, right: DataFrame, on: list[str], ready: str, at: str, carry: list[str]) -> DataFrame:
    """For each left row the first right row of the same keys with right.at >= left.ready, by at and then the carried
    columns; left rows without one are dropped."""
    best = F.min(F.struct(F.col(at).alias(at), *(F.col(c) for c in carry)))
    joined = left.join(right.select(*on, at, *carry), on).where(F.col(at) >= F.col(ready))
    return joined.groupBy(*left.columns).agg(best.alias("first")).select(*left.columns, f"first.{at}", *(f"first.{c}" for c in carry))
