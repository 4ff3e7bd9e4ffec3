"""Live delays over a static timetable.

A stream of reports (trip_id, pos, delay_seconds, reported_at) says by how much a trip is late from a place on. The latest
report of each trip and place within the watermark holds; joined with the static stop times it gives adjusted times on
the same trips and patterns, which searches read as they read the timetable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_reports(reports: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """The latest report of each trip and place in each window of event time."""
    return (
        reports.withWatermark("reported_at", late)
        .groupBy(F.window("reported_at", window), "trip_id", "pos")
        .agg(F.max_by("delay_seconds", "reported_at").alias("delay_seconds"), F.max("reported_at").alias("reported_at"))
        .select("trip_id", "pos", "delay_seconds", "reported_at")
    )


def delayed_visits(reports: DataFrame, stop_times: DataFrame) -> DataFrame:
    """A stream of adjusted visits: for each report the trip's visits from the reported place on."""
    visits = stop_times.select("trip_id", "pattern", "trip", F.col("pos").alias("at"), "stop", "arr", "dep")
    joined = reports.join(visits, "trip_id").where(F.col("at") >= F.col("pos"))
    return joined.select("trip_id", "pattern", "trip", F.col("at").alias("pos"), "stop", (F.col("arr") + F.col("delay_seconds")).alias("arr"), (F.col("dep") + F.col("delay_seconds")).alias("dep"), "reported_at")
