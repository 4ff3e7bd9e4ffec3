"""Snapshots: Parquet tables of a timetable or a road network, and readers and writers of the packed binary form.

Packed numbers are big-endian but for edge offsets, which are little-endian.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_tables(folder: str, **tables: DataFrame) -> None:
    """One Parquet table for each name, partitioned as the frames are."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_bucketed(frame: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key: joins on it need no shuffle of this side."""
    frame.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def _records(spark: SparkSession, path: str, kind: str, names: list[str], schema: str) -> DataFrame:
    """Fixed-width records of binary files, with their index."""
    record = np.dtype([(n, k) for n, k in zip(names, kind.split(), strict=True)])

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                found = np.frombuffer(content, record)
                for begin in range(0, len(found), 100_000):
                    part = found[begin : begin + 100_000]
                    out = pd.DataFrame({n: part[n].astype(part[n].dtype.newbyteorder("=")) for n in names})
                    out.insert(0, "idx", np.arange(begin, begin + len(part)))
                    yield out

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "idx bigint, " + schema)


def read_packed_roads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, easting, northing, origin_eligible), edges (src, dst, seconds)) of a packed road snapshot."""
    places = _records(spark, f"{folder}/nodes.bin", ">i4 >i4", ["easting", "northing"], "easting int, northing int")
    flags = _records(spark, f"{folder}/origin-eligible.bin", "u1", ["flag"], "flag int")
    nodes = places.join(flags, "idx").select(F.col("idx").alias("node"), "easting", "northing", (F.col("flag") == 1).alias("origin_eligible"))
    targets = _records(spark, f"{folder}/edges.bin", ">u4 >f4", ["dst", "seconds"], "dst bigint, seconds float")
    offsets = _records(spark, f"{folder}/edge-offsets.bin", "<u4", ["first"], "first bigint")
    bounds = offsets.join(offsets.select((F.col("idx") - 1).alias("idx"), F.col("first").alias("stop")), "idx").where("stop > first")
    edges = bounds.select(F.col("idx").alias("src"), F.explode(F.sequence("first", F.col("stop") - 1)).alias("at"))
    return nodes, edges.join(targets, F.col("at") == F.col("idx")).select("src", "dst", "seconds")


def read_packed_timetable(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """stops, patterns, stop_times and transfers of a packed timetable snapshot."""
    names = spark.read.schema("names array<string>, eastings array<int>, northings array<int>, parents array<string>").option("multiLine", True).json(f"{folder}/stops.json")
    stops = names.select(F.posexplode(F.arrays_zip("names", "eastings", "northings", "parents")).alias("stop", "s"))
    stops = stops.select(F.col("stop").cast("bigint"), F.col("s.names").alias("name"), F.col("s.eastings").alias("easting"), F.col("s.northings").alias("northing"), F.col("s.parents").alias("parent"))
    shape = "referenceDate string, stopCount int, patterns array<struct<stopSequence:array<bigint>,routeType:int,tripByteOffsets:array<bigint>>>, transfers array<array<bigint>>"
    manifest = spark.read.schema(shape).option("multiLine", True).json(f"{folder}/manifest.json")
    patterns = manifest.select(F.posexplode("patterns").alias("pattern", "p")).select(F.col("pattern").cast("bigint"), F.col("p.routeType").alias("mode"), F.col("p.stopSequence").alias("stop_seq"), F.col("p.tripByteOffsets").alias("offsets"))
    times = _records(spark, f"{folder}/stop-times.bin", ">u4 >u4", ["arr", "dep"], "arr bigint, dep bigint")
    trips = patterns.select("pattern", F.posexplode("offsets").alias("trip", "offset"), F.explode(F.sequence(F.lit(0), F.size("stop_seq") - 1)).alias("pos"))
    stop_times = trips.withColumn("idx", (F.col("offset") / 8).cast("bigint") + F.col("pos")).join(times, "idx").select("pattern", "trip", "pos", F.col("arr").cast("int"), F.col("dep").cast("int"))
    transfers = manifest.select(F.explode("transfers").alias("t")).select(F.col("t")[0].alias("from_stop"), F.col("t")[1].alias("to_stop"), F.col("t")[2].cast("int").alias("seconds"))
    return {"stops": stops, "patterns": patterns.drop("offsets"), "stop_times": stop_times, "transfers": transfers}


def edge_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, first, degree): row pointers of edges sorted by source. The running sum is global: for export."""
    degrees = nodes.select("node").join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "node", "left").fillna(0, "degree")
    before = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return degrees.select("node", F.coalesce(F.sum("degree").over(before), F.lit(0)).cast("bigint").alias("first"), F.col("degree").cast("bigint"))


def write_packed_roads(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The packed form, for programs that read it; it is one file of each kind, so it goes through the driver row by row."""
    from stridemap.sources.files import writer

    offsets = edge_offsets(edges, nodes)
    with writer(f"{folder}/nodes.bin") as places, writer(f"{folder}/origin-eligible.bin") as flags:
        for row in nodes.orderBy("node").toLocalIterator():
            places.write(np.array([row["easting"], row["northing"]], ">i4").tobytes())
            flags.write(bytes([int(row["origin_eligible"])]))
    with writer(f"{folder}/edge-offsets.bin") as out:
        last = 0
        for row in offsets.orderBy("node").toLocalIterator():
            out.write(np.array([row["first"]], "<u4").tobytes())
            last = row["first"] + row["degree"]
        out.write(np.array([last], "<u4").tobytes())
    with writer(f"{folder}/edges.bin") as out:
        for row in edges.orderBy("src", "dst", "seconds").toLocalIterator():
            out.write(np.array([row["dst"]], ">u4").tobytes() + np.array([row["seconds"]], ">f4").tobytes())


def write_packed_timetable(stops: DataFrame, pattern_rows: DataFrame, stop_times: DataFrame, transfers: DataFrame, folder: str, date: str) -> None:
    """manifest.json, stops.json and stop-times.bin; pattern_rows: (pattern, mode, stop_seq)."""
    from stridemap.sources.files import writer

    listed = [r.asDict() for r in stops.orderBy("stop").select("name", "easting", "northing", "parent").toLocalIterator()]
    with writer(f"{folder}/stops.json") as out:
        out.write(json.dumps({"names": [r["name"] for r in listed], "eastings": [r["easting"] for r in listed], "northings": [r["northing"] for r in listed], "parents": [r["parent"] for r in listed]}).encode())
    patterns, offsets, at = [], {}, 0
    with writer(f"{folder}/stop-times.bin") as out:
        for row in stop_times.orderBy("pattern", "trip", "pos").toLocalIterator():
            if row["pos"] == 0:
                offsets.setdefault(row["pattern"], []).append(at)
            out.write(np.array([row["arr"], row["dep"]], ">u4").tobytes())
            at += 8
    for row in pattern_rows.orderBy("pattern").toLocalIterator():
        patterns.append({"stopSequence": row["stop_seq"], "routeType": row["mode"], "tripByteOffsets": offsets.get(row["pattern"], [])})
    pairs = [[r["from_stop"], r["to_stop"], r["seconds"]] for r in transfers.orderBy("from_stop", "to_stop", "seconds").toLocalIterator()]
    with writer(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"referenceDate": date, "stopCount": len(listed), "patterns": patterns, "transfers": pairs}).encode())
