"""Feeds and graphs made from the test tables, with whole-number weights, so that SQL can check results exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemap.session import read
from stridemap.sources.gtfs import Feed

#: Stops that trips use; the parts above are stops without service.
RING = 60
REFERENCE_DATE = "20260101"

#: The row order within an order, which is unique.
IN_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def _hms(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)))


def transit_feed(spark: SparkSession, sf_dir: str, explicit: bool = True) -> Feed:
    """A feed: an order is a trip, each of its lines a visit, on a ring of 60 stops; parts are stops."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*IN_ORDER))
    visits = lines.select("l_orderkey", "l_suppkey", *IN_ORDER[:2], "l_quantity", seq.alias("seq"))
    visits = visits.select("l_orderkey", "l_suppkey", F.col("seq").cast("bigint").alias("seq"))
    arrival = F.lit(18000) + F.pmod(F.col("l_orderkey") * 7919, F.lit(1080)) * 60 + (F.col("seq") - 1) * 600
    timed = F.pmod(F.col("l_orderkey") + F.col("seq"), F.lit(97)) != 0
    stop_times = visits.select(
        F.col("l_orderkey").cast("string").alias("trip_id"),
        F.pmod(F.pmod("l_orderkey", F.lit(RING)) + F.col("seq") + F.pmod("l_suppkey", F.lit(3)), F.lit(RING)).cast("string").alias("stop_id"),
        F.col("seq").cast("string").alias("stop_sequence"),
        F.when(timed, _hms(arrival)).alias("arrival_time"),
        F.when(timed, _hms(arrival + 30)).alias("departure_time"),
    )
    trips = orders.select(F.col("o_orderkey").cast("string").alias("trip_id"), F.pmod("o_orderkey", F.lit(7)).cast("string").alias("service_id"), F.col("o_orderpriority").alias("route_id"))
    services = spark.range(7)
    calendar = services.select(F.col("id").cast("string").alias("service_id"), F.lit(REFERENCE_DATE).alias("date"), F.when(F.col("id") < 5, "1").otherwise("2").alias("exception_type"))
    kinds = spark.createDataFrame([("1-URGENT", "0"), ("2-HIGH", "1"), ("3-MEDIUM", "2"), ("4-NOT SPECIFIED", "3"), ("5-LOW", "4")], "route_id string, route_type string")
    stops = read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("stop_id"),
        F.col("p_name").alias("stop_name"),
        (46.9 + F.floor(F.col("p_partkey") / 8) * 0.004).cast("string").alias("stop_lat"),
        (7.4 + F.pmod("p_partkey", F.lit(8)) * 0.003).cast("string").alias("stop_lon"),
        F.lit("").alias("parent_station"),
    )
    ring = spark.range(RING if explicit else 0)
    seconds = F.when(F.pmod("id", F.lit(4)) == 0, "0").when(F.pmod("id", F.lit(2)) == 1, "90")
    transfers = ring.select(F.col("id").cast("string").alias("from_stop_id"), F.pmod(F.col("id") * 3 + 1, F.lit(RING)).cast("string").alias("to_stop_id"), seconds.alias("min_transfer_time"))
    return Feed(calendar_dates=calendar, trips=trips, routes=kinds, stops=stops, stop_times=stop_times, transfers=transfers)


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, seconds): parts that follow each other in an order."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*IN_ORDER))
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), after.alias("dst"), F.col("l_quantity").cast("int").alias("seconds"))
    return edges.where("dst is not null and dst <> src")


def road_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, easting, northing): parts on a grid of 500 columns, 97 m apart."""
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("node"), (2600000 + F.pmod("p_partkey", F.lit(500)) * 97).cast("int").alias("easting"), (1200000 + F.floor(F.col("p_partkey") / 500) * 97).cast("int").alias("northing"))
