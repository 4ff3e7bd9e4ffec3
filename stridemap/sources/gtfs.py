"""Timetable feeds: folders of CSV files with a header, every value a string."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that are read of each file; others may be there and are not parsed into the plan.
COLUMNS = {
    "calendar_dates": ("service_id", "date", "exception_type"),
    "trips": ("trip_id", "service_id", "route_id"),
    "routes": ("route_id", "route_type"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "parent_station"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"),
    "transfers": ("from_stop_id", "to_stop_id", "min_transfer_time"),
}


@dataclass(frozen=True)
class Feed:
    """One frame for each file, all columns strings."""

    calendar_dates: DataFrame
    trips: DataFrame
    routes: DataFrame
    stops: DataFrame
    stop_times: DataFrame
    transfers: DataFrame


def read_table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV file with quoted fields and doubled quotes; a column that the header lacks is null."""
    frame = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return frame.select(*(F.col(c) if c in frame.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_feed(spark: SparkSession, folder: str) -> Feed:
    return Feed(**{name: read_table(spark, f"{folder}/{name}.txt", columns) for name, columns in COLUMNS.items()})
