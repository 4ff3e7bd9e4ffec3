"""Itineraries as HTML fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridemap.functions.clock import format_clock
from stridemap.functions.geo import round_half_up
from stridemap.functions.labels import (
    TEXTS,
    WALK_COLOUR,
    change_text,
    duration_text,
    escape_html,
    fill,
    mode_colour,
    ride_text,
    segment_html,
    walk_text,
)
from stridemap.operators.raptor import journeys


def itinerary_html(reached: DataFrame, searches: DataFrame, stops: DataFrame, language: str = "en") -> DataFrame:
    """(search, dest, html) for each reached stop and for the origin itself."""
    texts = TEXTS[language]
    names = stops.select("stop", escape_html(F.col("name")).alias("name"))
    rows = journeys(reached).join(names.select(F.col("stop").alias("to_stop"), "name"), "to_stop", "left").withColumn("name", F.coalesce("name", F.lit("")))
    following = F.lead("dep").over(Window.partitionBy("search", "dest").orderBy("seq"))
    walk = F.col("kind") == "walk"
    body = segment_html(
        F.when(walk, F.lit(WALK_COLOUR)).otherwise(mode_colour(F.col("mode"))),
        F.when(walk, walk_text(F.col("dep"), F.col("arr"), F.col("name"), language)).otherwise(ride_text(F.col("mode"), F.col("dep"), F.col("arr"), F.col("name"), language)),
    )
    wait = F.when(F.col("next") > F.col("arr"), F.concat(F.lit('<div class="wait">'), fill(F.lit(texts["journey.wait"]), duration=duration_text(F.col("next") - F.col("arr"), language)), F.lit("</div>"))).otherwise(F.lit(""))
    lines = rows.withColumn("next", following).select("search", "dest", "seq", "kind", F.concat(body, wait).alias("line"))
    each = lines.groupBy("search", "dest").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "line")))["line"], "").alias("lines"), F.count_if(F.col("kind") == "ride").alias("rides"))
    each = each.join(reached.select("search", F.col("stop").alias("dest"), F.col("arr").alias("arrival")), ["search", "dest"]).join(searches.select("search", "origin", "departure"), "search")
    each = each.join(names.select(F.col("stop").alias("dest"), F.col("name").alias("dest_name")), "dest", "left").join(names.select(F.col("stop").alias("origin"), F.col("name").alias("origin_name")), "origin", "left")
    minutes = round_half_up((F.col("arrival") - F.col("departure")) / 60)
    summary = F.concat(fill(F.lit(texts["journey.summary"]), time=format_clock(F.col("arrival")), minutes=minutes), change_text(F.col("rides") - 1, language))
    head = lambda name, text: F.concat(F.lit('<div class="destination">'), F.coalesce(name, F.lit("")), F.lit('</div><div class="summary">'), text, F.lit("</div>"))
    start = segment_html(F.lit("transparent"), fill(F.lit(texts["journey.from"]), name=F.coalesce(F.col("origin_name"), F.lit(""))))
    there = each.select("search", "dest", F.concat(head(F.col("dest_name"), summary), start, F.col("lines")).alias("html"))
    here = searches.join(names, F.col("origin") == F.col("stop"), "left").select("search", F.col("origin").alias("dest"), head(F.col("name"), F.lit(texts["journey.alreadyHere"])).alias("html"))
    return there.unionByName(here)
