from __future__ import annotations

from stridemap.streaming.delays import delayed_visits, latest_reports


def test_delays_shift_later_visits(spark, tmp_path):
    rows = [("t1", 1, 60, "2026-01-01 08:00:00"), ("t1", 1, 120, "2026-01-01 08:01:00"), ("t2", 0, 30, "2026-01-01 08:00:30"), ("t9", 0, 0, "2026-01-01 09:00:00")]
    frame = spark.createDataFrame(rows, "trip_id string, pos int, delay_seconds int, at string").selectExpr("trip_id", "pos", "delay_seconds", "cast(at as timestamp) as reported_at")
    frame.write.parquet(str(tmp_path / "in"))
    times = spark.createDataFrame([("t1", 7, 0, p, p, 100 * p, 100 * p + 5) for p in range(3)], "trip_id string, pattern bigint, trip int, pos int, stop bigint, arr int, dep int")
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = delayed_visits(latest_reports(stream), times).writeStream.format("memory").queryName("delays").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    frame.where("trip_id = 't9'").write.mode("append").parquet(str(tmp_path / "in"))  # a batch in which the watermark has passed the first windows
    query.processAllAvailable()
    query.stop()
    streamed = spark.table("delays").collect()
    assert sorted((r["trip_id"], r["pos"], r["arr"], r["dep"]) for r in streamed) == [("t1", 1, 220, 225), ("t1", 2, 320, 325)]
    static = delayed_visits(latest_reports(frame), times)  # the same plan on a batch
    assert sorted((r["trip_id"], r["pos"], r["arr"], r["dep"]) for r in static.collect()) == [("t1", 1, 220, 225), ("t1", 2, 320, 325)]
