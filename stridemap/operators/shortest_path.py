"""Budgeted shortest paths over directed edges, for many searches at once: a frontier fixpoint.

Each round extends the nodes that the last one improved by one edge and keeps the least time of each node.
Edge times are above zero and a path's total only grows, so pruning by budget in every round is exact. Parallel edges
are reduced to the least first and written once. A round joins the frontier to them, broadcast where it has at most
`broadcast_rows` rows: then the edges are scanned where they lie; else both sides are shuffled by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap.session import discard, materialize, materialize_counted


def least_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.min(F.col("seconds").cast("double")).alias("seconds"))


def shortest_paths(edges: DataFrame, searches: DataFrame, max_rounds: int = 100_000, broadcast_rows: int = 500_000) -> DataFrame:
    """(search, node, seconds) for searches (search, origin, budget); the origin is there with 0."""
    graph = materialize(least_edges(edges), "edges")
    searches = materialize(searches.select("search", "origin", F.col("budget").cast("double")), "searches")
    few = searches.count() <= 100_000
    limit = F.broadcast(searches.select("search", "budget")) if few else searches.select("search", "budget")
    best = materialize(searches.select("search", F.col("origin").alias("node"), F.lit(0.0).alias("seconds"), F.lit(True).alias("fresh")), "best")
    n = 1 if few else broadcast_rows + 1
    for _ in range(max_rounds):
        frontier = best.where("fresh").select("search", F.col("node").alias("src"), F.col("seconds").alias("so_far"))
        if n <= broadcast_rows:  # counted while it was written
            frontier = F.broadcast(frontier)
        offers = graph.join(frontier, "src").select("search", F.col("dst").alias("node"), (F.col("so_far") + F.col("seconds")).alias("offer"))
        offers = offers.join(limit, "search").where(F.col("offer") <= F.col("budget")).groupBy("search", "node").agg(F.min("offer").alias("offer"))
        both = best.join(offers, ["search", "node"], "full")
        better = F.coalesce(F.col("offer") < F.col("seconds"), F.col("seconds").isNull())
        following, n = materialize_counted(both.select("search", "node", F.when(better, F.col("offer")).otherwise(F.col("seconds")).alias("seconds"), better.alias("fresh")), "fresh", "best")
        discard(best)
        best = following
        if n == 0:
            break
    discard(graph)
    return best.select("search", "node", "seconds")


def tree_edges(reached: DataFrame, edges: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, src, dst, seconds): for each reached node but the origin the edge that its time comes by; of equal
    ones that from the lowest node. seconds is the edge's time."""
    graph = least_edges(edges)
    start = reached.select("search", F.col("node").alias("src"), F.col("seconds").alias("at_src"))
    end = reached.select("search", F.col("node").alias("dst"), F.col("seconds").alias("at_dst"))
    tight = start.join(graph, "src").join(end, ["search", "dst"]).where(F.col("at_src") + F.col("seconds") == F.col("at_dst"))
    tight = tight.join(searches.select("search", F.col("origin")), "search").where(F.col("dst") != F.col("origin"))
    return tight.groupBy("search", "dst").agg(F.min("src").alias("src"), F.min_by("seconds", "src").alias("seconds")).select("search", "src", "dst", "seconds")


def routes_to(tree: DataFrame, targets: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, dest, seq, src, dst, seconds) for targets (search, dest): the tree's edges from the origin, in travel order. A
    target that wasn't reached, and the origin itself, have no rows.

    By doubling: after k rounds every target has its last 2**k edges, and every node the one 2**k edges before it, so the rounds are
    the logarithm of the longest path."""
    edges = materialize(tree.select("search", "dst", "src", "seconds"), "tree")
    jump = edges.select("search", F.col("dst").alias("node"), F.col("src").alias("up"))
    # (search, dest, node, back): a node on the way to dest, back edges before it
    on_way = materialize(targets.select("search", "dest", F.col("dest").alias("node"), F.lit(0).cast("bigint").alias("back")), "ways")
    step = 1
    while True:
        further = on_way.join(jump, ["search", "node"]).select("search", "dest", F.col("up").alias("node"), (F.col("back") + step).alias("back"), F.lit(True).alias("fresh"))
        following, n = materialize_counted(on_way.withColumn("fresh", F.lit(False)).unionByName(further), "fresh", "ways")
        discard(on_way)
        on_way = following.drop("fresh")
        on_way._stridemap_path = following._stridemap_path
        if n == 0:
            break
        doubled = jump.select("search", "node", F.col("up").alias("middle")).join(jump.select("search", F.col("node").alias("middle"), "up"), ["search", "middle"])
        doubled = materialize(doubled.select("search", "node", "up"), "jumps")
        if step > 1:
            discard(jump)
        jump, step = doubled, step * 2
    used = on_way.join(edges.withColumnRenamed("dst", "node"), ["search", "node"])
    last = used.groupBy("search", "dest").agg(F.max("back").alias("last"))
    return used.join(last, ["search", "dest"]).select("search", "dest", (F.col("last") - F.col("back")).alias("seq"), "src", F.col("node").alias("dst"), "seconds")


def edges_from(edges: DataFrame, node: int) -> DataFrame:
    """The edges that leave a node; on a table bucketed by src that reads one bucket."""
    return edges.where(F.col("src") == node)
