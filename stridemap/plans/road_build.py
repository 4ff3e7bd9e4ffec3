"""From a street export to directed edges, kept nodes and origin flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap.functions.geo import lv95
from stridemap.functions.roads import direction, speed_kmh, travel_seconds
from stridemap.operators.components import connected_components, in_large_components, strong_components

LEAST_WEAK = 10
LEAST_STRONG = 20


def placed(nodes: DataFrame) -> DataFrame:
    east, north = lv95(F.col("lat"), F.col("lon"))
    return nodes.select("node", east.alias("easting"), north.alias("northing"))


def way_segments(ways: DataFrame) -> DataFrame:
    """(way, pos, a, b, kmh, direction): consecutive nodes, without a shuffle."""
    tags = F.col("tags")
    rows = ways.select("way", "nodes", speed_kmh(tags["highway"], tags["maxspeed"]).alias("kmh"), direction(tags["highway"], tags["oneway"]).alias("direction")).where(F.size("nodes") > 1)
    n = F.size("nodes")
    pairs = F.arrays_zip(F.slice("nodes", F.lit(1), n - 1).alias("a"), F.slice("nodes", F.lit(2), n - 1).alias("b"))
    return rows.select("way", "kmh", "direction", F.posexplode(pairs).alias("pos", "s")).select("way", "pos", "s.a", "s.b", "kmh", "direction")


def measured(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Segments with both ends known, and their length in metres (0 for coinciding ends)."""
    start = places.select(F.col("node").alias("a"), F.col("easting").alias("e1"), F.col("northing").alias("n1"))
    end = places.select(F.col("node").alias("b"), F.col("easting").alias("e2"), F.col("northing").alias("n2"))
    both = segments.join(start, "a").join(end, "b")
    de, dn = (F.col("e2") - F.col("e1")).cast("double"), (F.col("n2") - F.col("n1")).cast("double")
    return both.select("way", "pos", "a", "b", "kmh", "direction", F.sqrt(de * de + dn * dn).alias("metres"))


def directed_edges(segments: DataFrame) -> DataFrame:
    """(src, dst, seconds) of measured segments; a segment without length gives none."""
    seconds = travel_seconds(F.col("metres"), F.col("kmh")).alias("seconds")
    ways = F.array(
        F.struct(F.lit(0).alias("reverse"), F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.lit(1).alias("reverse"), F.col("b").alias("src"), F.col("a").alias("dst")),
    )
    rows = segments.where("metres > 0").select(seconds, "direction", F.explode(ways).alias("e"))
    kept = rows.where(((F.col("e.reverse") == 0) & (F.col("direction") >= 0)) | ((F.col("e.reverse") == 1) & (F.col("direction") <= 0)))
    return kept.select("e.src", "e.dst", "seconds")


def dangling(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Segments with an end that the export lacks."""
    known = places.select("node")
    missing = segments.join(known, segments["a"] == known["node"], "left_anti")
    other = segments.join(known, segments["a"] == known["node"], "left_semi")
    return missing.unionByName(other.join(known, other["b"] == known["node"], "left_anti"))


def road_network(edges: DataFrame, places: DataFrame, least_weak: int = LEAST_WEAK, least_strong: int = LEAST_STRONG) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, easting, northing, origin_eligible), edges) of weak components of least_weak nodes or more; a
    node may be an origin if its strong component has least_strong."""
    kept = in_large_components(connected_components(edges), least_weak)
    inner = edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    eligible = in_large_components(strong_components(inner), least_strong).withColumn("flag", F.lit(True))
    nodes = places.join(kept, "node", "left_semi").join(eligible, "node", "left")
    return nodes.select("node", "easting", "northing", F.coalesce("flag", F.lit(False)).alias("origin_eligible")), inner
