"""Road tags: speed, direction, travel time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: km/h by road class where no numeric maxspeed is tagged.
CLASS_SPEEDS = {
    "motorway": 120,
    "motorway_link": 40,
    "trunk": 80,
    "trunk_link": 50,
    "primary": 80,
    "primary_link": 40,
    "secondary": 80,
    "secondary_link": 40,
    "tertiary": 80,
    "tertiary_link": 40,
    "unclassified": 80,
    "residential": 50,
    "living_street": 20,
}
OTHER_SPEED = 50
ONE_WAY_CLASSES = ("motorway", "motorway_link")


def speed_kmh(highway: Column, maxspeed: Column) -> Column:
    """A positive numeric maxspeed, else the class's speed, else 50."""
    number = F.when(maxspeed.rlike(r"^\s*[0-9]*\.?[0-9]+\s*$"), F.trim(maxspeed).try_cast("double"))
    by_class = F.element_at(F.create_map(*(F.lit(x) for pair in CLASS_SPEEDS.items() for x in pair)), highway)
    return F.when(number > 0, number).otherwise(F.coalesce(by_class, F.lit(OTHER_SPEED)).cast("double"))


def direction(highway: Column, oneway: Column) -> Column:
    """1 forward, -1 reverse, 0 both."""
    tagged = F.when(oneway == "yes", 1).when(oneway == "-1", -1).when(oneway == "no", 0)
    return F.coalesce(tagged, F.when(highway.isin(*ONE_WAY_CLASSES), 1).otherwise(0))


def travel_seconds(metres: Column, kmh: Column) -> Column:
    return metres / (kmh * 1000 / 3600)
