"""Coordinates: WGS84 to the Swiss LV95 grid, distances, square and hexagonal cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WALK_METRES_PER_SECOND = 1.2
WALK_RADIUS = 300
WALK_EXTRA_SECONDS = 60
HEX_SIZE = 180

#: swisstopo's published approximation of LV95, as (factor, power of longitude, power of latitude).
EASTING = ((2600072.37, 0, 0), (211455.93, 1, 0), (-10938.51, 1, 1), (-0.36, 1, 2), (-44.54, 3, 0))
NORTHING = ((1200147.07, 0, 0), (308807.95, 0, 1), (3745.25, 2, 0), (76.63, 0, 2), (-194.56, 2, 1), (119.79, 0, 3))


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def _polynomial(terms, lon: Column, lat: Column) -> Column:
    total = None
    for factor, i, j in terms:
        term = F.lit(factor)
        for base, power in ((lon, i), (lat, j)):
            for _ in range(power):
                term = term * base
        total = term if total is None else total + term
    return total


def lv95(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) in whole metres."""
    y = (lat * 3600 - 169028.66) / 10000
    x = (lon * 3600 - 26782.5) / 10000
    return tuple(round_half_up(_polynomial(terms, x, y)).cast("int") for terms in (EASTING, NORTHING))


def squared_distance(e1: Column, n1: Column, e2: Column, n2: Column) -> Column:
    de, dn = (e1 - e2).cast("bigint"), (n1 - n2).cast("bigint")
    return de * de + dn * dn


def walk_seconds(metres: Column) -> Column:
    return (round_half_up(metres / F.lit(WALK_METRES_PER_SECOND)) + WALK_EXTRA_SECONDS).cast("int")


def cell(coordinate: Column, size: int) -> Column:
    return F.floor(coordinate / F.lit(float(size))).cast("int")


def hex_centre(q: Column, r: Column, size: float = HEX_SIZE) -> tuple[Column, Column]:
    """Offsets of a pointy-top cell's centre in axial coordinates."""
    return F.lit(size * math.sqrt(3.0)) * (q + r / F.lit(2.0)), F.lit(size * 1.5) * r


def hex_ring(x: Column, y: Column, size: float = HEX_SIZE) -> Column:
    """The seven points of a closed ring."""
    turn = lambda k: F.radians((F.lit(60) * k - 30).cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct((x + size * F.cos(turn(k))).alias("x"), (y + size * F.sin(turn(k))).alias("y")))


def near_hex(x: Column, y: Column, size: float = HEX_SIZE) -> tuple[Column, Column]:
    """A cell at or next to the point."""
    q = (x * math.sqrt(3.0) / 3 - y / 3) / F.lit(float(size))
    r = y * 2 / 3 / F.lit(float(size))
    return round_half_up(q), round_half_up(r)


def elapsed_hue(elapsed: Column, budget: Column) -> Column:
    """130 (at once) down to 0 (the whole budget)."""
    return F.lit(130.0) * (1 - F.least(F.greatest(elapsed / budget, F.lit(0.0)), F.lit(1.0)))
