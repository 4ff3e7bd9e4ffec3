"""From a feed and a date to stops, patterns, trips and transfers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from stridemap.functions.clock import parse_service_time
from stridemap.functions.geo import WALK_RADIUS, lv95, walk_seconds
from stridemap.operators.joins import pairs_within
from stridemap.sources.gtfs import Feed

DEFAULT_TRANSFER_SECONDS = 120


@dataclass(frozen=True)
class Timetable:
    """stops (stop, stop_id, name, easting, northing, parent); patterns (pattern, mode, stop_seq, n_trips, fifo);
    pattern_stops (pattern, pos, stop); stop_times (pattern, trip, pos, stop, arr, dep, trip_id); transfers (from_stop, to_stop, seconds, kind);
    trips (pattern, trip, trip_id, visits), the stop times by trip, where they are at hand."""

    stops: DataFrame
    patterns: DataFrame
    pattern_stops: DataFrame
    stop_times: DataFrame
    transfers: DataFrame
    trips: DataFrame | None = None


def active_services(feed: Feed, date: str) -> DataFrame:
    return feed.calendar_dates.where((F.col("date") == date) & (F.col("exception_type") == "1")).select("service_id").distinct()


def active_trips(feed: Feed, date: str) -> DataFrame:
    return feed.trips.join(active_services(feed, date), "service_id", "left_semi")


def indexed_stops(feed: Feed) -> DataFrame:
    """Stops with a dense number, by length and text of their id. A missing or bad coordinate is null."""
    east, north = lv95(F.col("stop_lat").try_cast("double"), F.col("stop_lon").try_cast("double"))
    number = F.row_number().over(Window.orderBy(F.length("stop_id"), "stop_id")) - 1
    return feed.stops.select(number.cast("bigint").alias("stop"), "stop_id", F.coalesce("stop_name", F.lit("")).alias("name"), east.alias("easting"), north.alias("northing"), F.coalesce("parent_station", F.lit("")).alias("parent"))


def active_visits(feed: Feed, date: str) -> DataFrame:
    """(trip_id, stop_id, seq, arr, dep) of active trips; arr or dep is null where the feed has no good time."""
    trips = active_trips(feed, date).select("trip_id")
    found = feed.stop_times.join(trips, "trip_id", "left_semi")
    return found.select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), parse_service_time(F.col("arrival_time")).alias("arr"), parse_service_time(F.col("departure_time")).alias("dep"))


def timed(visits: DataFrame) -> DataFrame:
    return visits.where("arr is not null and dep is not null")


def counted(visits: DataFrame) -> tuple[DataFrame, Observation]:
    """The same visits, and counters that fill while whatever reads them runs, without a pass of their own."""
    seen = Observation("visits")
    untimed = F.col("arr").isNull() | F.col("dep").isNull()
    return visits.observe(seen, F.count("*").alias("n_rows"), F.count_if(untimed).alias("n_untimed")), seen


def trip_sequences(visits: DataFrame, stops: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(trip_id, route_type, stop_seq, visits) of trips with two or more timed visits at known stops."""
    known = visits.join(stops.select("stop_id", "stop"), "stop_id")
    visit = F.struct("seq", "stop", "arr", "dep")
    # a filter before the join would be pushed into the feed's plan and parse all times again
    good = F.filter(F.collect_list(visit), lambda v: v["arr"].isNotNull() & v["dep"].isNotNull())
    each = known.groupBy("trip_id").agg(F.array_sort(good).alias("visits")).where(F.size("visits") >= 2)
    kinds = routes.select("route_id", F.col("route_type").try_cast("int").alias("route_type"))
    typed = trips.select("trip_id", "route_id").join(kinds, "route_id", "left").select("trip_id", F.coalesce("route_type", F.lit(-1)).alias("route_type"))
    return each.join(typed, "trip_id").select("trip_id", "route_type", F.col("visits.stop").alias("stop_seq"), "visits")


def explicit_transfers(feed: Feed, stops: DataFrame) -> DataFrame:
    given = F.coalesce(F.col("min_transfer_time").try_cast("double"), F.lit(0.0))
    ends = stops.select("stop_id", "stop")
    rows = feed.transfers.join(ends.select(F.col("stop_id").alias("from_stop_id"), F.col("stop").alias("from_stop")), "from_stop_id")
    rows = rows.join(ends.select(F.col("stop_id").alias("to_stop_id"), F.col("stop").alias("to_stop")), "to_stop_id").where("from_stop <> to_stop")
    return rows.select("from_stop", "to_stop", F.when((given == 0) | F.isnan(given), DEFAULT_TRANSFER_SECONDS).otherwise(given).cast("int").alias("seconds"))


def walking_transfers(stops: DataFrame, used: DataFrame, explicit: DataFrame) -> DataFrame:
    """Walks between used stops within 300 m, where no explicit transfer joins the two in that direction."""
    near = pairs_within(stops.join(used, "stop", "left_semi"), WALK_RADIUS)
    walks = near.select(F.col("a").alias("from_stop"), F.col("b").alias("to_stop"), walk_seconds(F.sqrt(F.col("d2").cast("double"))).alias("seconds"))
    return walks.join(explicit.select("from_stop", "to_stop"), ["from_stop", "to_stop"], "left_anti")


def overtaking(stop_times: DataFrame) -> DataFrame:
    """(pattern) of patterns where a later trip arrives or departs before an earlier one at some stop."""
    before = Window.partitionBy("pattern", "pos").orderBy("trip")
    rows = stop_times.select("pattern", (F.lag("arr").over(before) > F.col("arr")).alias("a"), (F.lag("dep").over(before) > F.col("dep")).alias("d"))
    return rows.where("a or d").select("pattern").distinct()


def pattern_name(stop_seq: Column) -> Column:
    return F.array_join(F.transform(stop_seq, lambda s: s.cast("string")), "-")


def build(feed: Feed, date: str, keep: Callable[[DataFrame, str], DataFrame] = lambda frame, name: frame) -> Timetable:
    """keep, such as materialize(), is given the stops, the visits and the numbered trips: with it, the tables are made from those and the
    feed is read once; without, each table is one lazy plan over the feed."""
    stops = keep(indexed_stops(feed), "stops")
    visits = keep(active_visits(feed, date), "visits")  # what the feed shuffled for them can go before they are dealt out again
    trips = trip_sequences(visits, stops, active_trips(feed, date), feed.routes)
    trips = trips.withColumn("pattern", F.xxhash64("stop_seq"))
    order = Window.partitionBy("pattern").orderBy(F.col("visits")[0]["dep"], F.length("trip_id"), "trip_id")
    # what overtaking() finds, without dealing out the stop times again
    late = F.exists(F.zip_with("visits", F.lag("visits").over(order), lambda v, b: (b["arr"] > v["arr"]) | (b["dep"] > v["dep"])), lambda x: x)
    trips = keep(trips.withColumns({"trip": F.row_number().over(order) - 1, "late": F.coalesce(late, F.lit(False))}), "trips")
    stop_times = trips.select("pattern", "trip", "trip_id", F.posexplode("visits").alias("pos", "v")).select("pattern", "trip", "pos", "v.stop", "v.arr", "v.dep", "trip_id")
    patterns = trips.groupBy("pattern", "stop_seq").agg(F.min_by("route_type", F.struct(F.length("trip_id"), "trip_id")).alias("mode"), F.count("*").alias("n_trips"), (~F.bool_or("late")).alias("fifo"))
    patterns = patterns.select("pattern", "mode", "stop_seq", "n_trips", "fifo")
    pattern_stops = patterns.select("pattern", F.posexplode("stop_seq").alias("pos", "stop"))
    explicit = explicit_transfers(feed, stops)
    walks = walking_transfers(stops, pattern_stops.select("stop").distinct(), explicit)
    transfers = explicit.withColumn("kind", F.lit("explicit")).unionByName(walks.withColumn("kind", F.lit("walk")))
    return Timetable(stops, patterns, pattern_stops, stop_times, transfers, trips.select("pattern", "trip", "trip_id", "visits"))
