from __future__ import annotations

from pyspark.sql import functions as F

from stridemap.functions import clock, geo, labels, roads


def values(spark, column, rows, schema="k int, x string"):
    frame = spark.createDataFrame(list(enumerate(rows)), schema)
    return [r[0] for r in frame.orderBy("k").select(column).collect()]


def test_service_times(spark):
    assert values(spark, clock.parse_service_time(F.col("x")), ["08:15:30", "25:10:00", "7:00:01", "08:15", "", None, "x:1:2"]) == [29730, 90600, 25201, None, None, None, None]


def test_form_times(spark):
    assert values(spark, clock.parse_departure(F.col("x")), ["08:15", "", None, "7", ":30"]) == [29700, 0, 28800, 25200, 1800]


def test_clock(spark):
    seconds = F.col("x").cast("int")
    assert values(spark, clock.format_clock(seconds), ["0", "29730", "90600", "360000"]) == ["00:00", "08:15", "25:10", "100:00"]
    assert values(spark, clock.whole_minutes(seconds), ["0", "1", "60", "61"]) == [1, 1, 1, 2]


def test_rounding_goes_up(spark):
    assert values(spark, geo.round_half_up(F.col("x").cast("double")), ["-2.5", "2.5", "-2.6", "0.49"]) == [-2, 3, -3, 0]


def test_cells_floor(spark):
    assert values(spark, geo.cell(F.col("x").cast("int"), 300), ["-1", "0", "299", "300"]) == [-1, 0, 0, 1]


def test_lv95_of_the_grid_origin(spark):
    east, north = geo.lv95(F.lit(46.951082877), F.lit(7.438632495))
    row = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert abs(row["e"] - 2_600_000) <= 1 and abs(row["n"] - 1_200_000) <= 1


def test_speeds(spark):
    rows = [("motorway", None), ("residential", "30"), ("primary", "50 mph"), ("track", "0"), ("trunk", "none"), ("primary", " 1.5 "), ("primary", "50d")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, h string, m string")
    assert [r[0] for r in frame.orderBy("k").select(roads.speed_kmh(F.col("h"), F.col("m"))).collect()] == [120, 30, 80, 50, 80, 1.5, 80]


def test_directions(spark):
    rows = [("motorway", None), ("motorway_link", "no"), ("residential", None), ("residential", "yes"), ("residential", "-1"), ("motorway", "reversible"), ("residential", "true")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, h string, o string")
    assert [r[0] for r in frame.orderBy("k").select(roads.direction(F.col("h"), F.col("o"))).collect()] == [1, 0, 0, 1, -1, 1, 0]


def test_texts(spark):
    assert values(spark, labels.escape_html(F.col("x")), ['a & "b" <c>', "&amp;"]) == ["a &amp; &quot;b&quot; &lt;c&gt;", "&amp;amp;"]
    assert values(spark, labels.fill(F.lit("{a} {b}"), a=F.col("x")), ["1"]) == ["1 {b}"]
    assert values(spark, labels.change_text(F.col("x").cast("int"), "en"), ["-1", "0", "1", "2"]) == ["", "", " · 1 change", " · 2 changes"]
    assert {len(t) for t in labels.TEXTS.values()} == {17}


def test_hue(spark):
    assert values(spark, geo.elapsed_hue(F.col("x").cast("double"), F.lit(100.0)), ["-5", "0", "50", "100", "300"]) == [130, 130, 65, 0, 0]
