"""Hand-built timetables: searches, journeys, legs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stridemap.operators import raptor
from stridemap.plans.itinerary import itinerary_html
from stridemap.plans.transit_build import Timetable, overtaking

RAIL, BUS, FERRY = 2, 3, 4


def timetable(spark, patterns, transfers=()):
    """patterns: (stops, mode, trips), a trip a list of times or (arr, dep) pairs, in order of departure."""
    rows, times = [], []
    for p, (stops, mode, trips) in enumerate(patterns):
        rows.append((p, mode, list(stops), len(trips)))
        for t, trip in enumerate(trips):
            for pos, time in enumerate(trip):
                arr, dep = time if isinstance(time, tuple) else (time, time)
                times.append((p, t, pos, stops[pos], arr, dep, f"{p}-{t}"))
    stop_times = spark.createDataFrame(times, "pattern bigint, trip int, pos int, stop bigint, arr int, dep int, trip_id string")
    frame = spark.createDataFrame(rows, "pattern bigint, mode int, stop_seq array<bigint>, n_trips bigint")
    late = overtaking(stop_times).withColumn("late", F.lit(True))
    frame = frame.join(late, "pattern", "left").withColumn("fifo", F.col("late").isNull()).drop("late")
    n = 1 + max([s for stops, _, _ in patterns for s in stops] + [s for t in transfers for s in t[:2]])
    stops = spark.createDataFrame([(s, str(s), f"Stop {s}", s * 100, 0, "") for s in range(n)], "stop bigint, stop_id string, name string, easting int, northing int, parent string")
    walks = spark.createDataFrame([(*t, "explicit") for t in transfers], "from_stop bigint, to_stop bigint, seconds int, kind string")
    return Timetable(stops, frame, frame.select("pattern", F.posexplode("stop_seq").alias("pos", "stop")), stop_times, walks)


def search(spark, table, origin=0, departure=0, budget=1000, rounds=8):
    asked = spark.createDataFrame([(0, origin, departure, budget)], "search int, origin bigint, departure int, budget int")
    return raptor.reach(table, asked, rounds), asked


def stops_of(reached):
    return {r["stop"]: (r["arr"], r["rides"]) for r in reached.collect()}


def test_horizon(spark):
    reached, _ = search(spark, timetable(spark, [((0, 1, 2, 3), RAIL, [[0, 100, 200, 300]])]), budget=250)
    assert stops_of(reached) == {1: (100, 1), 2: (200, 1)}


def test_next_trip(spark):
    reached, _ = search(spark, timetable(spark, [((0, 1), BUS, [[0, 100], [200, 300]])]), departure=150, budget=200)
    assert stops_of(reached) == {1: (300, 1)}


def transfer_table(spark, ferry):
    return timetable(spark, [((0, 1), RAIL, [[0, 100]]), ((2, 3), FERRY, [ferry])], [(1, 2, 60)])


def test_transfer_and_journey(spark):
    reached, asked = search(spark, transfer_table(spark, [200, 400]), budget=500)
    assert stops_of(reached) == {1: (100, 1), 2: (160, 1), 3: (400, 2)}
    there = [tuple(r) for r in raptor.journey_to(reached, 0, 3, 0).select("kind", "from_stop", "to_stop", "dep", "arr", "mode").collect()]
    assert there == [("ride", 0, 1, 0, 100, RAIL), ("walk", 1, 2, 100, 160, None), ("ride", 2, 3, 200, 400, FERRY)]
    assert raptor.journey_to(reached, 0, 0, 0).count() == 0
    assert raptor.journey_to(reached, 0, 99, 0) is None
    legs = {tuple(r) for r in raptor.network_legs(reached).select("kind", "from_stop", "to_stop", "dep", "arr").collect()}
    assert legs == {("ride", 0, 1, 0, 100), ("walk", 1, 2, 100, 160), ("ride", 2, 3, 200, 400)}
    table = transfer_table(spark, [200, 400])
    html = {r["dest"]: r["html"] for r in itinerary_html(reached, asked, table.stops).collect()}
    assert "You are already here." in html[0]
    assert html[3].startswith('<div class="destination">Stop 3</div><div class="summary">Arrive 00:06 · 7 min · 1 change</div>')
    assert '<div class="wait">Wait 1 min</div>' in html[3] and "Walk 1 min to Stop 2" in html[3] and "Ferry 00:03 → 00:06 to Stop 3" in html[3]


def test_missed_connection(spark):
    reached, _ = search(spark, transfer_table(spark, [50, 100]), budget=500)
    assert set(stops_of(reached)) == {1, 2}


def test_shared_leg_once(spark):
    reached, _ = search(spark, timetable(spark, [((0, 1), RAIL, [[0, 100]]), ((1, 2), RAIL, [[100, 200]]), ((1, 3), RAIL, [[100, 180]])]), budget=300)
    assert set(stops_of(reached)) == {1, 2, 3}
    assert raptor.network_legs(reached).where("from_stop = 0 and to_stop = 1").count() == 1


def test_walk_only(spark):
    reached, _ = search(spark, timetable(spark, [((5, 6), BUS, [[0, 1]])], [(0, 1, 300)]), budget=400)
    assert stops_of(reached) == {1: (300, 0)}


def test_origin_is_fixed(spark):
    table = timetable(spark, [((0, 1), RAIL, [[(0, 100), (50, 50)]])], [(1, 0, 0)])
    reached, _ = search(spark, table, departure=100, budget=400)
    assert stops_of(reached) == {1: (50, 1)}
    assert raptor.network_legs(reached).where("to_stop = 0").count() == 0


def test_walks_do_not_chain(spark):
    reached, _ = search(spark, timetable(spark, [((8, 9), BUS, [[0, 1]])], [(0, 1, 10), (1, 2, 10)]))
    assert stops_of(reached) == {1: (10, 0)}


def test_budget_met_exactly_and_past_midnight(spark):
    reached, _ = search(spark, timetable(spark, [((0, 1), BUS, [[86_300, 90_000]])]), departure=86_000, budget=4_000)
    assert stops_of(reached) == {1: (90_000, 1)}


def test_overtaking_trips(spark):
    # the later trip arrives first; a running minimum of trip numbers would miss it
    table = timetable(spark, [((0, 1, 2), BUS, [[0, 500, 900], [10, 100, 200]])])
    assert table.patterns.first()["fifo"] is False
    reached, _ = search(spark, table)
    assert stops_of(reached) == {1: (100, 1), 2: (200, 1)}


def test_repeated_stop_and_equal_arrivals(spark):
    table = timetable(spark, [((0, 1, 0, 2), BUS, [[0, 100, 200, 300]]), ((0, 2), RAIL, [[50, 300]])])
    reached, _ = search(spark, table)
    assert stops_of(reached) == {1: (100, 1), 2: (300, 1)}


def test_many_searches_in_one_job(spark):
    table = timetable(spark, [((0, 1, 2, 3), RAIL, [[0, 100, 200, 300], [500, 600, 700, 800]])])
    asked = spark.createDataFrame([(0, 0, 0, 250), (1, 1, 0, 150), (2, 1, 400, 500), (3, 9, 0, 100)], "search int, origin bigint, departure int, budget int")
    found = {(r["search"], r["stop"]): r["arr"] for r in raptor.reach(table, asked).collect()}
    assert found == {(0, 1): 100, (0, 2): 200, (2, 2): 700, (2, 3): 800}


def test_more_budget_reaches_no_less(spark):
    from stridemap.plans import transit_queries as tq

    table = tq._snapshot(spark, "/root/testdata/sf0.001")[1]
    asked = spark.createDataFrame([(0, 0, 28_800, 1_800), (1, 0, 28_800, 5_400)], "search int, origin bigint, departure int, budget int")
    rows = raptor.reach(table, asked).collect()
    small, large = ({r["stop"]: r["arr"] for r in rows if r["search"] == k} for k in (0, 1))
    assert small and all(large[s] <= a <= 30_600 for s, a in small.items())
    for r in rows:  # segments chain from the origin to the stop
        ends = [(s["from_stop"], s["to_stop"], s["dep"], s["arr"]) for s in r["path"]]
        assert ends[0][0] == 0 and ends[-1][1] == r["stop"] and ends[-1][3] == r["arr"]
        assert all(a[1] == b[0] and a[3] <= b[2] for a, b in zip(ends, ends[1:]))


def shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def plain_arrivals(patterns, transfers, origin, departure, budget, rounds=8):
    """Earliest arrivals, every trip followed from its first place that is reached in time."""
    deadline, by_ride = departure + budget, {origin: departure}

    def walked(known):
        out = dict(known)
        for a, b, seconds in transfers:
            if a in known and b != origin and known[a] + seconds <= min(deadline, out.get(b, deadline)):
                out[b] = known[a] + seconds
        return out

    total = marked = walked(by_ride)
    for _ in range(rounds):
        improved = {}
        for stops, _, trips in patterns:
            for trip in trips:
                on = next((k for k, s in enumerate(stops) if s in marked and trip[k] >= marked[s]), len(stops))
                for s, time in zip(stops[on + 1 :], trip[on + 1 :], strict=True):
                    if s != origin and time <= deadline and time < min(by_ride.get(s, deadline + 1), improved.get(s, deadline + 1)):
                        improved[s] = time
        by_ride |= improved
        marked = {s: t for s, t in walked(improved).items() if t < total.get(s, deadline + 1)}
        total = total | marked
    return {s: t for s, t in total.items() if s != origin}


def test_boardings_and_candidates_are_not_shuffled(spark):
    # every search meets every line at each of its places; half the patterns have a trip that overtakes
    draw = random.Random(5)
    patterns = []
    for k in range(80):
        stops = [draw.randrange(12) for _ in range(6)]
        trips = sorted([t0 + i * step for i in range(6)] for t0, step in ((draw.randrange(3000), 60) for _ in range(8)))
        if k % 2:
            trips = sorted([*trips, [trips[0][0] + 1 + i * 20 for i in range(6)]])
        patterns.append((stops, BUS, trips))
    transfers = [(s, (s * 5 + 1) % 12, 45) for s in range(12) if s != (s * 5 + 1) % 12]
    table = raptor.Prepared(timetable(spark, patterns, transfers))
    asked = spark.createDataFrame([(k, k % 12, 60 * k, 900) for k in range(24)], "search int, origin bigint, departure int, budget int")
    before = shuffled_rows(spark)
    found = raptor.reach(table, asked)
    rows = found.collect()
    moved = shuffled_rows(spark) - before
    for k in range(24):
        assert {r["stop"]: r["arr"] for r in rows if r["search"] == k} == plain_arrivals(patterns, transfers, k % 12, 60 * k, 900)
    # labels, walks and the best rides of each task; not 24 searches x 700 trips x 6 places
    assert moved < 20_000
    assert all(r["path"][-1]["arr"] == r["arr"] and r["path"][0]["from_stop"] == r["search"] % 12 for r in rows)
    in_blocks = raptor.reach(table, asked, block_rows=7).collect()
    assert sorted(map(tuple, in_blocks)) == sorted(map(tuple, rows))
