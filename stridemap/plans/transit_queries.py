"""Queries over the transit fixture."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.functions.geo import elapsed_hue, hex_centre, hex_ring
from stridemap.operators import places, raptor
from stridemap.operators.joins import asof_first
from stridemap.plans import transit_build as tb
from stridemap.plans.itinerary import itinerary_html
from stridemap.session import materialize, release, shared_dir
from stridemap.sources.fixtures import REFERENCE_DATE, transit_feed
from stridemap.sources.gtfs import COLUMNS, read_feed

DEPARTURE, BUDGET, ORIGIN = 28_800, 5_400, 0
BATCH = 60
ROUNDS = 6

# ---- SQL ------------------------------------------------------------------------------------------------------------

FEED_SQL = """
raw AS (SELECT l_orderkey AS trip, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq FROM lineitem),
feed_visits AS (SELECT trip, (trip % 60 + seq + l_suppkey % 3) % 60 AS stop, seq, 18000 + (trip * 7919 % 1080) * 60 + (seq - 1) * 600 AS arr, (trip + seq) % 97 <> 0 AS timed FROM raw),
active AS (SELECT o_orderkey AS trip, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS route_type FROM orders WHERE o_orderkey % 7 < 5),
visits AS (SELECT v.trip, v.stop, v.seq, v.arr, v.arr + 30 AS dep FROM feed_visits v JOIN active USING (trip) WHERE timed),
tv AS (SELECT trip, stop, arr, dep, row_number() OVER (PARTITION BY trip ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY trip) AS n FROM visits QUALIFY n >= 2),
trip_rows AS (SELECT trip, array_to_string(list(stop ORDER BY pos), '-') AS pattern, min(dep) AS dep0, count(*) AS n_stops FROM tv GROUP BY trip),
numbered AS (SELECT trip, pattern, n_stops, row_number() OVER (PARTITION BY pattern ORDER BY dep0, trip) - 1 AS idx FROM trip_rows),
pattern_modes AS (SELECT pattern, arg_min(route_type, n.trip) AS mode FROM numbered n JOIN active USING (trip) GROUP BY pattern),
part_places AS (SELECT p_partkey AS stop, p_name AS name,
  ((46.9::DOUBLE + floor(p_partkey / 8::DOUBLE) * 0.004::DOUBLE) * 3600 - 169028.66::DOUBLE) / 10000 AS y,
  ((7.4::DOUBLE + (p_partkey % 8) * 0.003::DOUBLE) * 3600 - 26782.5::DOUBLE) / 10000 AS x FROM part),
stops AS (SELECT stop, name,
  CAST(floor(2600072.37::DOUBLE + 211455.93::DOUBLE * x + -10938.51::DOUBLE * x * y + -0.36::DOUBLE * x * y * y + -44.54::DOUBLE * x * x * x + 0.5::DOUBLE) AS INT) AS easting,
  CAST(floor(1200147.07::DOUBLE + 308807.95::DOUBLE * y + 3745.25::DOUBLE * x * x + 76.63::DOUBLE * y * y + -194.56::DOUBLE * x * x * y + 119.79::DOUBLE * y * y * y + 0.5::DOUBLE) AS INT) AS northing FROM part_places),
explicit AS (SELECT i AS from_stop, (i * 3 + 1) % 60 AS to_stop, CASE WHEN i % 2 = 1 THEN 90 ELSE 120 END AS seconds FROM range(60) r(i) WHERE i <> (i * 3 + 1) % 60),
used AS (SELECT s.* FROM stops s SEMI JOIN tv USING (stop)),
walking AS (SELECT a.stop AS from_stop, b.stop AS to_stop, CAST(floor(sqrt((CAST(a.easting AS BIGINT) - b.easting) ** 2 + (CAST(a.northing AS BIGINT) - b.northing) ** 2) / 1.2::DOUBLE + 0.5::DOUBLE) + 60 AS INT) AS seconds
  FROM used a JOIN used b ON a.stop <> b.stop AND (CAST(a.easting AS BIGINT) - b.easting) ** 2 + (CAST(a.northing AS BIGINT) - b.northing) ** 2 <= 90000
  WHERE NOT EXISTS (SELECT 1 FROM explicit e WHERE e.from_stop = a.stop AND e.to_stop = b.stop)),
walks AS (SELECT from_stop, to_stop, min(seconds) AS seconds FROM (SELECT * FROM explicit UNION ALL SELECT * FROM walking) GROUP BY ALL)
"""


def _search_sql(searches: str) -> str:
    """The rounds, unrolled. searches: SQL of rows (search, origin, departure, deadline)."""
    rank = "ORDER BY arr, rides, on_foot, trip, board_pos, from_stop"
    seg = "{{'kind': {0}, 'from_stop': {1}, 'to_stop': {2}, 'dep': {3}, 'arr': {4}, 'mode': {5}, 'pattern': {6}, 'board_pos': {7}, 'alight_pos': {8}}}"
    ride = seg.format("'ride'", "b.stop", "s.stop", "b.dep", "s.arr", "m.mode", "n.pattern", "b.pos", "s.pos")
    walk = seg.format("'walk'", "t.stop", "w.to_stop", "t.arr", "t.arr + w.seconds", "NULL::INT", "NULL::VARCHAR", "NULL::BIGINT", "NULL::BIGINT")
    empty = "list_filter([" + seg.format("''", "0::BIGINT", "0::BIGINT", "0::BIGINT", "0::BIGINT", "0::INT", "''", "0::BIGINT", "0::BIGINT") + "], lambda z: false)"
    out = [f"searches AS MATERIALIZED ({searches})", f"t0 AS MATERIALIZED (SELECT search, origin AS stop, departure AS arr, 0 AS rides, {empty} AS path FROM searches)"]

    def walked(name: str, source: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT search, stop, arr, rides, path FROM (
          SELECT search, stop, arr, rides, 0 AS on_foot, 0 AS trip, 0 AS board_pos, -1 AS from_stop, path FROM {source}
          UNION ALL SELECT t.search, w.to_stop, t.arr + w.seconds, t.rides, 1, 0, 0, w.from_stop, list_append(t.path, {walk}) FROM {source} t JOIN walks w ON w.from_stop = t.stop JOIN searches q ON q.search = t.search
            WHERE t.arr + w.seconds <= q.deadline AND w.to_stop <> q.origin) QUALIFY row_number() OVER (PARTITION BY search, stop {rank}) = 1)"""

    def merged(name: str, old: str, new: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT * FROM {old} o WHERE NOT EXISTS (SELECT 1 FROM {new} n WHERE n.search = o.search AND n.stop = o.stop AND n.arr < o.arr)
          UNION ALL SELECT n.* FROM {new} n WHERE NOT EXISTS (SELECT 1 FROM {old} o WHERE n.search = o.search AND n.stop = o.stop AND n.arr >= o.arr))"""

    out.append(walked("r0", "t0"))
    for k in range(1, ROUNDS + 1):
        out.append(f"""b{k} AS MATERIALIZED (SELECT r.search, s.trip, s.pos, s.dep, r.stop, r.rides, r.path FROM r{k - 1} r JOIN tv s ON s.stop = r.stop AND s.dep >= r.arr
          QUALIFY row_number() OVER (PARTITION BY r.search, s.trip ORDER BY s.pos) = 1)""")
        out.append(f"""c{k} AS MATERIALIZED (SELECT search, stop, arr, rides, path FROM (
          SELECT b.search, s.stop, s.arr, b.rides + 1 AS rides, 0 AS on_foot, b.trip, b.pos AS board_pos, b.stop AS from_stop, list_append(b.path, {ride}) AS path
          FROM b{k} b JOIN tv s ON s.trip = b.trip AND s.pos > b.pos JOIN numbered n ON n.trip = b.trip JOIN pattern_modes m ON m.pattern = n.pattern JOIN searches q ON q.search = b.search
          WHERE s.arr <= q.deadline AND s.stop <> q.origin) QUALIFY row_number() OVER (PARTITION BY search, stop {rank}) = 1)""")
        out.append(f"i{k} AS MATERIALIZED (SELECT c.* FROM c{k} c LEFT JOIN t{k - 1} t ON t.search = c.search AND t.stop = c.stop WHERE t.arr IS NULL OR c.arr < t.arr)")
        out.append(merged(f"t{k}", f"t{k - 1}", f"i{k}"))
        out.append(walked(f"s{k}", f"i{k}"))
        out.append(merged(f"r{k}", f"r{k - 1}", f"s{k}"))
    out.append(f"reached AS MATERIALIZED (SELECT r.* FROM r{ROUNDS} r JOIN searches q ON q.search = r.search WHERE r.stop <> q.origin)")
    out.append("segments AS (SELECT search, stop AS dest, generate_subscripts(path, 1) - 1 AS seq, unnest(path) AS s FROM reached)")
    return ",\n".join(out)


ONE_SQL = f"SELECT 0 AS search, {ORIGIN} AS origin, {DEPARTURE} AS departure, {DEPARTURE + BUDGET} AS deadline"
BATCH_SQL = f"SELECT i AS search, i AS origin, {DEPARTURE} + i * 60 AS departure, {DEPARTURE} + i * 60 + 3600 AS deadline FROM range({BATCH}) r(i)"
LEGS_SQL = """legs AS (SELECT DISTINCT ON (search, key) search, kind, from_stop, to_stop, dep, arr, mode FROM (
  SELECT search, dest, s.kind, s.from_stop, s.to_stop, s.dep, s.arr, s.mode,
    CASE WHEN s.kind = 'walk' THEN 'w' || s.from_stop || ':' || s.to_stop ELSE s.pattern || ':' || s.board_pos || ':' || s.alight_pos END AS key FROM segments)
  ORDER BY search, key, dest, dep, arr)"""


def _sql(tail: str, search: str | None = None, *more: str) -> str:
    parts = [FEED_SQL, *([_search_sql(search)] if search else []), *more]
    return "WITH " + ",\n".join(parts) + "\n" + tail


# ---- frames ---------------------------------------------------------------------------------------------------------


def _timetable(spark: SparkSession, sf_dir: str) -> tb.Timetable:
    return tb.build(transit_feed(spark, sf_dir), REFERENCE_DATE)


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, ORIGIN, DEPARTURE, BUDGET)], "search int, origin bigint, departure int, budget int")


@lru_cache(maxsize=4)
def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[tb.Timetable, raptor.Prepared]:
    """The built timetable, written: searches read the snapshot, as a service would, and don't rebuild it."""
    def keep(frame: DataFrame, name: str) -> DataFrame:
        out = materialize(frame, name)
        release(spark)
        return out

    built = tb.build(transit_feed(spark, sf_dir), REFERENCE_DATE, keep)  # stop_times unfolds its trips, which are written
    patterns = keep(built.patterns, "patterns")
    places_ = patterns.select("pattern", F.posexplode("stop_seq").alias("pos", "stop"))
    table = tb.Timetable(built.stops, patterns, places_, built.stop_times, keep(built.transfers, "transfers"), built.trips)
    return table, raptor.Prepared(table)


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raptor.reach(_snapshot(spark, sf_dir)[1], _one(spark))


def active_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.active_services(transit_feed(spark, sf_dir), REFERENCE_DATE)


def active_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.active_trips(transit_feed(spark, sf_dir), REFERENCE_DATE).select("trip_id", "service_id", "route_id")


def trips_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = transit_feed(spark, sf_dir)
    joined = tb.active_trips(feed, REFERENCE_DATE).join(F.broadcast(feed.routes), "route_id", "left")
    return joined.groupBy(F.coalesce("route_type", F.lit("unknown")).alias("route_type")).agg(F.count("*").alias("n_trips"))


def matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = tb.active_visits(transit_feed(spark, sf_dir), REFERENCE_DATE)
    return visits.agg(F.count("*").alias("n_rows"), F.count_distinct("stop_id").alias("n_stops"))


def stop_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _timetable(spark, sf_dir)
    return table.stop_times.select(F.col("trip_id").cast("bigint").alias("trip_id"), "pos", "stop", "arr", "dep")


def csv_stop_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stop_visits of the feed written as CSV files and scanned again."""
    feed = transit_feed(spark, sf_dir)
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    for name in COLUMNS:
        getattr(feed, name).write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.txt")
    table = tb.build(read_feed(spark, folder), REFERENCE_DATE)
    return table.stop_times.select(F.col("trip_id").cast("bigint").alias("trip_id"), "pos", "stop", "arr", "dep")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timetable(spark, sf_dir).patterns.select(tb.pattern_name(F.col("stop_seq")).alias("pattern"), "mode", "n_trips", F.size("stop_seq").cast("bigint").alias("n_stops"))


def pattern_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _timetable(spark, sf_dir)
    names = table.patterns.select("pattern", tb.pattern_name(F.col("stop_seq")).alias("name"))
    trips = table.stop_times.where("pos = 0").join(names, "pattern")
    return trips.select(F.col("name").alias("pattern"), F.col("trip").cast("bigint").alias("trip"), F.col("trip_id").cast("bigint").alias("trip_id"))


def patterns_at_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timetable(spark, sf_dir).pattern_stops.groupBy("stop").agg(F.count("*").alias("n_places"), F.count_distinct("pattern").alias("n_patterns"))


def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = transit_feed(spark, sf_dir)
    visits = tb.active_visits(feed, REFERENCE_DATE)
    counts = visits.agg(F.count("*").alias("n_visits"), F.count_if(F.col("arr").isNull() | F.col("dep").isNull()).alias("n_untimed"))
    shapes = tb.build(feed, REFERENCE_DATE).patterns.agg(F.count("*").alias("n_patterns"), F.sum("n_trips").alias("n_trips"), F.sum(F.col("n_trips") * F.size("stop_seq")).alias("n_entries"))
    return counts.join(shapes)


def stops_lv95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.indexed_stops(transit_feed(spark, sf_dir)).select("stop", "name", "easting", "northing")


def explicit_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = transit_feed(spark, sf_dir)
    return tb.explicit_transfers(feed, tb.indexed_stops(feed))


def walking_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timetable(spark, sf_dir).transfers.where("kind = 'walk'").drop("kind")


def all_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timetable(spark, sf_dir).transfers


def fifo_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timetable(spark, sf_dir).patterns.where("not fifo").select(tb.pattern_name(F.col("stop_seq")).alias("pattern"), "n_trips")


def earliest_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _timetable(spark, sf_dir)
    asked = table.pattern_stops.where("pos = 0").select("pattern", "stop", F.lit(DEPARTURE).alias("ready"))
    found = asof_first(asked, table.stop_times.where("pos = 0"), ["pattern"], "ready", "dep", ["trip"])
    names = table.patterns.select("pattern", tb.pattern_name(F.col("stop_seq")).alias("name"))
    return found.join(names, "pattern").select(F.col("name").alias("pattern"), "stop", F.col("trip").cast("bigint").alias("trip"), "dep")


def transit_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir).select("stop", "arr", "rides")


def _many(spark: SparkSession) -> DataFrame:
    return spark.range(BATCH).select(F.col("id").cast("int").alias("search"), F.col("id").alias("origin"), (DEPARTURE + F.col("id") * 60).cast("int").alias("departure"), F.lit(3600).alias("budget"))


def transit_reach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raptor.reach(_snapshot(spark, sf_dir)[1], _many(spark)).select("search", "stop", "arr", "rides")


def transit_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raptor.network_legs(_reached(spark, sf_dir)).drop("search")


def journey_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raptor.journeys(_reached(spark, sf_dir)).drop("search").withColumn("wait", F.expr("lead(dep) OVER (PARTITION BY dest ORDER BY seq) - arr"))


def itinerary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = _snapshot(spark, sf_dir)[0].stops
    reached = _reached(spark, sf_dir)
    frames = [itinerary_html(reached, _one(spark), stops, lang).withColumn("lang", F.lit(lang)) for lang in ("en", "fr", "de")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).drop("search")


def transit_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = raptor.reach(_snapshot(spark, sf_dir)[1], _many(spark))
    return places.transit_tips(reached.drop("path"), raptor.network_legs(reached), _many(spark))


def isochrone_hexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = _snapshot(spark, sf_dir)[0].stops.select("stop", F.col("easting").cast("double").alias("e"), F.col("northing").cast("double").alias("n"))
    search = _one(spark)
    origin = search.join(stops, F.col("origin") == F.col("stop")).select("search", "departure", "budget", F.col("e").alias("e0"), F.col("n").alias("n0"))
    reached = _reached(spark, sf_dir).select("search", "stop", "arr").unionByName(search.select("search", F.col("origin").alias("stop"), F.col("departure").alias("arr")))
    sources = reached.join(stops, "stop").join(F.broadcast(origin), "search")
    sources = sources.select("search", (F.col("e") - F.col("e0")).alias("x"), (F.col("n") - F.col("n0")).alias("y"), (F.col("arr") - F.col("departure")).cast("double").alias("elapsed"), F.col("budget").cast("double").alias("budget"))
    cells = places.isochrone(sources).join(F.broadcast(origin), "search")
    cx, cy = hex_centre(F.col("q"), F.col("r"))
    ring = hex_ring(cx + F.col("e0"), cy + F.col("n0"))
    return cells.select("q", "r", F.round("elapsed", 6).alias("elapsed"), F.round(elapsed_hue(F.col("elapsed"), F.col("budget")), 6).alias("hue"), F.round(ring[0]["x"], 4).alias("x0"), F.round(ring[0]["y"], 4).alias("y0"))


def nearest_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _snapshot(spark, sf_dir)[0]
    used = table.stops.join(table.pattern_stops.select("stop").distinct(), "stop", "left_semi")
    clicks = spark.range(20).select(F.col("id").cast("int").alias("target"), (2597000 + F.col("id") * 137).cast("int").alias("easting"), (1194000 + F.col("id") * 211).cast("int").alias("northing"))
    return places.nearest(used, clicks, "stop")


def stop_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _snapshot(spark, sf_dir)[0]
    return places.names_to_stops(table.stops, table.pattern_stops.select("stop").distinct())


def earliest_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir).select("stop", "arr").orderBy("arr", "stop").limit(10)


def latest_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir).select("stop", "arr").orderBy(F.desc("arr"), "stop").limit(5)


def legs_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("kind") == "walk", F.lit("transfer")).otherwise(F.col("mode").cast("string"))
    return raptor.network_legs(_reached(spark, sf_dir)).groupBy(mode.alias("mode")).agg(F.count("*").alias("n_legs"))


QUERIES = {f.__name__: f for f in (active_services, active_trips, trips_by_mode, matched_rows, stop_visits, csv_stop_visits, patterns, pattern_trips, patterns_at_stop, build_counters, stops_lv95, explicit_transfers, walking_transfers, all_transfers, fifo_violations, earliest_trip, transit_reach, transit_reach_batch, transit_legs, journey_to, itinerary_text, transit_tips, isochrone_hexes, nearest_stop, stop_by_name, earliest_10, latest_5, legs_by_mode)}


def _itinerary_sql() -> str:
    from stridemap.functions.labels import MODES, OTHER_MODE, TEXTS, WALK_COLOUR

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    put = lambda text, **v: f"{'replace(' * len(v)}{quote(text)}{''.join(f', {quote(chr(123) + k + chr(125))}, CAST({x} AS VARCHAR))' for k, x in v.items())}"
    clock = lambda s: f"format('{{:02d}}:{{:02d}}', CAST(floor(({s}) / 3600.0) AS INT), CAST(floor((({s}) % 3600) / 60.0) AS INT))"
    minutes = lambda s: f"greatest(1, CAST(ceil(({s}) / 60.0) AS BIGINT))"
    escape = "replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    parts = []
    for lang, t in TEXTS.items():
        label = "CASE x.mode " + " ".join(f"WHEN {m} THEN {quote(t[key])}" for m, (key, _) in MODES.items()) + f" ELSE {quote(t[OTHER_MODE[0]])} END"
        colour = "CASE x.mode " + " ".join(f"WHEN {m} THEN {quote(c)}" for m, (_, c) in MODES.items()) + f" ELSE {quote(OTHER_MODE[1])} END"
        duration = lambda s, t=t: put(t["journey.minutes"], count=minutes(s))
        text = f"CASE WHEN x.kind = 'walk' THEN {put(t['journey.walk'], duration=duration('x.arr - x.dep'), name='coalesce(x.name, chr(39) || chr(39))'.replace('chr(39) || chr(39)', quote('')))} ELSE {put(t['journey.ride'], mode=label, departure=clock('x.dep'), arrival=clock('x.arr'), name='x.name')} END"
        box = lambda c, s: f"'<div class=\"segment\"><span class=\"mode-dot\" style=\"background:' || {c} || '\"></span><span class=\"text\">' || {s} || '</span></div>'"
        colour_or = f"CASE WHEN x.kind = 'walk' THEN {quote(WALK_COLOUR)} ELSE {colour} END"
        line = f"{box(colour_or, text)} || CASE WHEN x.nxt > x.arr THEN '<div class=\"wait\">' || {put(t['journey.wait'], duration=duration('x.nxt - x.arr'))} || '</div>' ELSE '' END"
        head = lambda n, s: f"'<div class=\"destination\">' || {n} || '</div><div class=\"summary\">' || {s} || '</div>'"
        change = f"CASE WHEN e.rides - 1 <= 0 THEN '' WHEN e.rides - 1 = 1 THEN {put(t['journey.change.one'], count='e.rides - 1')} ELSE {put(t['journey.change.other'], count='e.rides - 1')} END"
        summary = put(t["journey.summary"], time=clock("r.arr"), minutes=f"CAST(floor((r.arr - {DEPARTURE}) / 60.0 + 0.5) AS BIGINT)") + f" || {change}"
        start = box("'transparent'", put(t["journey.from"], name=f"(SELECT name FROM named WHERE stop = {ORIGIN})"))
        parts.append(f"""SELECT r.stop AS dest, {head('d.name', summary)} || {start} || e.lines AS html, '{lang}' AS lang FROM reached r JOIN named d ON d.stop = r.stop JOIN (
            SELECT dest, string_agg({line}, '' ORDER BY seq) AS lines, count(*) FILTER (kind = 'ride') AS rides FROM steps x GROUP BY dest) e ON e.dest = r.stop
            UNION ALL SELECT stop, {head('name', quote(t['journey.alreadyHere']))}, '{lang}' FROM named WHERE stop = {ORIGIN}""")
    named = f"named AS (SELECT stop, {escape} AS name FROM stops)"
    steps = "steps AS (SELECT dest, seq, s.kind, s.dep, s.arr, s.mode, n.name, lead(s.dep) OVER (PARTITION BY dest ORDER BY seq) AS nxt FROM segments LEFT JOIN named n ON n.stop = s.to_stop)"
    return _sql(" UNION ALL ".join(parts), ONE_SQL, named, steps)


ISO_SQL = f"""
, src AS (SELECT (s.easting - o.easting)::DOUBLE AS x, (s.northing - o.northing)::DOUBLE AS y, (r.arr - {DEPARTURE})::DOUBLE AS el
  FROM (SELECT stop, arr FROM reached UNION ALL SELECT {ORIGIN}, {DEPARTURE}) r JOIN stops s USING (stop), (SELECT * FROM stops WHERE stop = {ORIGIN}) o),
sized AS (SELECT *, ({BUDGET} - el) * 1.2::DOUBLE AS radius FROM src WHERE {BUDGET} - el > 0),
bounds AS (SELECT CAST(floor(min(y - radius) / 270) - 2 AS BIGINT) AS r1, CAST(ceil(max(y + radius) / 270) + 2 AS BIGINT) AS r2, CAST(floor(min(x - radius) / 311) - 2 AS BIGINT) AS c1, CAST(ceil(max(x + radius) / 311) + 2 AS BIGINT) AS c2 FROM sized),
cells AS (SELECT r, c - CAST(floor(r / 2.0) AS BIGINT) AS q FROM (SELECT unnest(range(r1, r2 + 1)) AS r, c1, c2 FROM bounds), LATERAL (SELECT unnest(range(c1 - 1, c2 + 2)) AS c)),
centres AS (SELECT q, r, 180 * sqrt(3.0::DOUBLE) * (q + r / 2.0::DOUBLE) AS cx, 180 * 1.5::DOUBLE * r AS cy FROM cells),
best AS (SELECT q, r, cx, cy, min(el + sqrt((cx - x) ** 2 + (cy - y) ** 2) / 1.2::DOUBLE) AS elapsed FROM centres JOIN sized ON sqrt((cx - x) ** 2 + (cy - y) ** 2) <= radius GROUP BY ALL)
SELECT q, r, round(elapsed, 6) AS elapsed, round(130 * (1 - least(greatest(elapsed / {BUDGET}::DOUBLE, 0), 1)), 6) AS hue,
  round(cx + o.easting + 180 * cos(radians(-30.0::DOUBLE)), 4) AS x0, round(cy + o.northing + 180 * sin(radians(-30.0::DOUBLE)), 4) AS y0 FROM best, (SELECT * FROM stops WHERE stop = {ORIGIN}) o
"""

ORACLES = {
    "active_services": "SELECT CAST(i AS VARCHAR) AS service_id FROM range(5) r(i)",
    "active_trips": "SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(o_orderkey % 7 AS VARCHAR) AS service_id, o_orderpriority AS route_id FROM orders WHERE o_orderkey % 7 < 5",
    "trips_by_mode": "SELECT CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS VARCHAR) AS route_type, count(*) AS n_trips FROM orders WHERE o_orderkey % 7 < 5 GROUP BY ALL",
    "matched_rows": _sql("SELECT count(*) AS n_rows, count(DISTINCT stop) AS n_stops FROM feed_visits JOIN active USING (trip)"),
    "stop_visits": _sql("SELECT trip AS trip_id, pos, stop, arr, dep FROM tv"),
    "csv_stop_visits": _sql("SELECT trip AS trip_id, pos, stop, arr, dep FROM tv"),
    "patterns": _sql("SELECT pattern, mode, count(*) AS n_trips, any_value(n_stops) AS n_stops FROM numbered JOIN pattern_modes USING (pattern) GROUP BY pattern, mode"),
    "pattern_trips": _sql("SELECT pattern, idx AS trip, trip AS trip_id FROM numbered"),
    "patterns_at_stop": _sql("SELECT stop, count(*) AS n_places, count(DISTINCT pattern) AS n_patterns FROM (SELECT DISTINCT pattern, pos, stop FROM tv JOIN numbered USING (trip)) GROUP BY stop"),
    "build_counters": _sql("SELECT (SELECT count(*) FROM feed_visits JOIN active USING (trip)) AS n_visits, (SELECT count(*) FROM feed_visits JOIN active USING (trip) WHERE NOT timed) AS n_untimed, count(DISTINCT pattern) AS n_patterns, count(*) AS n_trips, CAST(sum(n_stops) AS BIGINT) AS n_entries FROM numbered"),
    "stops_lv95": _sql("SELECT stop, name, easting, northing FROM stops"),
    "explicit_transfers": _sql("SELECT * FROM explicit"),
    "walking_transfers": _sql("SELECT * FROM walking"),
    "all_transfers": _sql("SELECT *, 'explicit' AS kind FROM explicit UNION ALL SELECT *, 'walk' FROM walking"),
    "fifo_violations": _sql("""SELECT pattern, count(DISTINCT trip) AS n_trips FROM numbered WHERE pattern IN (SELECT pattern FROM
      (SELECT pattern, arr < lag(arr) OVER w OR dep < lag(dep) OVER w AS late FROM tv JOIN numbered USING (trip) WINDOW w AS (PARTITION BY pattern, pos ORDER BY idx)) WHERE late) GROUP BY pattern"""),
    "earliest_trip": _sql(f"SELECT pattern, any_value(stop) AS stop, arg_min(idx, (dep, idx)) AS trip, min(dep) AS dep FROM tv JOIN numbered USING (trip) WHERE pos = 0 AND dep >= {DEPARTURE} GROUP BY pattern"),
    "transit_reach": _sql("SELECT stop, arr, rides FROM reached", ONE_SQL),
    "transit_reach_batch": _sql("SELECT search, stop, arr, rides FROM reached", BATCH_SQL),
    "transit_legs": _sql("SELECT * EXCLUDE (search) FROM legs", ONE_SQL, LEGS_SQL),
    "journey_to": _sql("SELECT dest, seq, s.kind, s.from_stop, s.to_stop, s.dep, s.arr, s.mode, lead(s.dep) OVER (PARTITION BY dest ORDER BY seq) - s.arr AS wait FROM segments", ONE_SQL),
    "itinerary_text": _itinerary_sql(),
    "transit_tips": _sql("SELECT r.search, r.stop, r.arr FROM reached r JOIN searches q ON q.search = r.search WHERE q.deadline - r.arr <= 180 AND NOT EXISTS (SELECT 1 FROM legs l WHERE l.search = r.search AND l.from_stop = r.stop)", BATCH_SQL, LEGS_SQL),
    "isochrone_hexes": "WITH " + FEED_SQL + ",\n" + _search_sql(ONE_SQL) + ISO_SQL,
    "nearest_stop": _sql("""SELECT target, stop, d2 FROM (SELECT i AS target, stop, (easting - (2597000 + i * 137)) ** 2 + (northing - (1194000 + i * 211)) ** 2 AS d, CAST(d AS BIGINT) AS d2
      FROM used, range(20) r(i)) QUALIFY row_number() OVER (PARTITION BY target ORDER BY d2, stop) = 1"""),
    "stop_by_name": _sql("SELECT name, min(stop) AS stop FROM used WHERE name <> '' GROUP BY name"),
    "earliest_10": _sql("SELECT stop, arr FROM reached ORDER BY arr, stop LIMIT 10", ONE_SQL),
    "latest_5": _sql("SELECT stop, arr FROM reached ORDER BY arr DESC, stop LIMIT 5", ONE_SQL),
    "legs_by_mode": _sql("SELECT CASE WHEN kind = 'walk' THEN 'transfer' ELSE CAST(mode AS VARCHAR) END AS mode, count(*) AS n_legs FROM legs GROUP BY ALL", ONE_SQL, LEGS_SQL),
}
