from __future__ import annotations

from stridemap.operators.joins import asof_first, pairs_within
from stridemap.plans import transit_build as tb
from stridemap.sources import snapshots
from stridemap.sources.gtfs import read_feed

FILES = {
    "calendar_dates.txt": "service_id,date,exception_type\ns1,20260819,1\ns2,20260819,2\ns3,20260818,1\n",
    "trips.txt": "route_id,service_id,trip_id\nr1,s1,t1\nr1,s1,t2\nr9,s1,t3\nr1,s2,t4\nr1,s1,t5\n",
    "routes.txt": "route_id,route_type\nr1,3\n",
    "stops.txt": 'stop_id,stop_name,stop_lat,stop_lon,parent_station\na,"Genève, Cornavin",46.95,7.43,\nb,"The ""Hub""",46.9505,7.4305,p\nc,C,46.96,7.44,\nd,D,,,\ne,E,46.9503,7.4303,\n',
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    "t1,08:00:00,08:00:30,a,1\nt1,25:10:00,25:10:00,b,10\nt1,09:00:00,09:00:00,c,2\n"
    "t2,07:00:00,07:00:00,a,1\nt2,08:00:00,08:00:00,c,2\nt2,08:30:00,08:30:00,b,3\n"
    "t3,07:00:00,07:00:00,b,1\nt3,,,c,2\nt3,07:30:00,07:30:00,d,3\n"
    "t4,07:00:00,07:00:00,a,1\nt4,07:10:00,07:10:00,b,2\n"
    "t5,07:00:00,07:00:00,a,1\nt5,07:10:00,07:10:00,nowhere,2\n",
    "transfers.txt": "from_stop_id,to_stop_id,min_transfer_time\na,b,0\nb,a,\na,a,60\nc,a,95\na,nowhere,5\n",
}


def feed(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, encoding="utf-8-sig" if name == "stops.txt" else "utf-8")
    return read_feed(spark, str(tmp_path))


def test_build(spark, tmp_path):
    own = feed(spark, tmp_path)
    table = tb.build(own, "20260819")
    stops = {r["stop_id"]: r for r in table.stops.collect()}
    assert stops["a"]["name"] == "Genève, Cornavin" and stops["b"]["name"] == 'The "Hub"'
    assert stops["d"]["easting"] is None
    a, b, c, d = (stops[x]["stop"] for x in "abcd")
    patterns = {tuple(r["stop_seq"]): r for r in table.patterns.collect()}
    assert set(patterns) == {(a, c, b), (b, d)}
    assert patterns[(a, c, b)]["n_trips"] == 2 and patterns[(a, c, b)]["mode"] == 3 and patterns[(b, d)]["mode"] == -1
    first = table.stop_times.where("trip = 0 and pos = 0").collect()
    assert {r["trip_id"] for r in first} == {"t2", "t3"}  # the earlier departure comes first
    late = table.stop_times.where("trip_id = 't1' and pos = 2").first()
    assert (late["arr"], late["stop"]) == (90_600, b)
    explicit = {(r["from_stop"], r["to_stop"], r["seconds"]) for r in table.transfers.where("kind = 'explicit'").collect()}
    assert explicit == {(a, b, 120), (b, a, 120), (c, a, 95)}
    assert table.transfers.where("kind = 'walk'").count() == 0  # a-b is explicit, e is not used


def test_counts(spark, tmp_path):
    own = feed(spark, tmp_path)
    visits = tb.active_visits(own, "20260819")
    frame, seen = tb.counted(visits)
    assert tb.timed(frame).count() == 10 and seen.get == {"n_rows": 11, "n_untimed": 1}


def test_names_and_platforms(spark, tmp_path):
    from stridemap.operators import places

    table = tb.build(feed(spark, tmp_path), "20260819")
    names = places.names_to_stops(table.stops, table.pattern_stops.select("stop").distinct())
    ids = {r["stop_id"]: r["stop"] for r in table.stops.collect()}
    assert places.stop_of_name(names, " C ") == ids["c"] and places.stop_of_name(names, "E") is None
    assert places.first_platform(table.stops, 'The "Hub"') == ids["b"] and places.first_platform(table.stops, "C") is None


def test_packed_timetable_round_trip(spark, tmp_path):
    table = tb.build(feed(spark, tmp_path), "20260819")
    numbers = {r["pattern"]: k for k, r in enumerate(table.patterns.orderBy("pattern").collect())}
    rename = spark.createDataFrame(list(numbers.items()), "pattern bigint, number bigint")
    number = lambda df: df.join(rename, "pattern").drop("pattern").withColumnRenamed("number", "pattern")
    patterns, times = number(table.patterns), number(table.stop_times)
    out = str(tmp_path / "packed")
    snapshots.write_packed_timetable(table.stops.fillna(0), patterns, times, table.transfers, out, "20260819")
    got = snapshots.read_packed_timetable(spark, out)
    want = {(r["pattern"], r["trip"], r["pos"], r["arr"], r["dep"]) for r in times.collect()}
    assert {tuple(r) for r in got["stop_times"].collect()} == want
    assert got["transfers"].count() == table.transfers.count() and got["stops"].count() == 5


def test_pairs_within_is_exact(spark):
    import random

    rng = random.Random(5)
    rows = [(k, rng.randrange(-900, 900), rng.randrange(-900, 900)) for k in range(120)] + [(500, None, 3)]
    got = {(r["a"], r["b"]) for r in pairs_within(spark.createDataFrame(rows, "stop bigint, easting int, northing int"), 300).collect()}
    near = rows[:-1]
    assert got == {(p[0], q[0]) for p in near for q in near if p != q and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 90_000}


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 11), (2, 0)], "k int, ready int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (2, 7, "d"), (2, 7, "c")], "k int, at int, v string")
    got = {tuple(r) for r in asof_first(left, right, ["k"], "ready", "at", ["v"]).collect()}
    assert got == {(1, 5, 5, "a"), (2, 0, 7, "c")}
