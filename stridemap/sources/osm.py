"""Street exports: JSON documents with an `elements` list of nodes and ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, lat, lon), ways (way, nodes, tags)) of one or many documents."""
    elements = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    nodes = elements.where("e.type = 'node'").select(F.col("e.id").alias("node"), "e.lat", "e.lon")
    ways = elements.where("e.type = 'way'").select(F.col("e.id").alias("way"), "e.nodes", "e.tags")
    return nodes, ways
