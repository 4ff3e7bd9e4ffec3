"""Queries over the road fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.functions.roads import direction, speed_kmh
from stridemap.operators import components, places, shortest_path
from stridemap.plans import road_build as rb
from stridemap.session import materialize, read
from stridemap.sources import fixtures, snapshots

BUDGET = 40
ORIGIN = 0
#: Origins of the batch: every node whose number this divides.
EVERY = 50

EDGE_SQL = """
after AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst, CAST(l_quantity AS INT) AS seconds FROM lineitem),
edges AS (SELECT * FROM after WHERE dst IS NOT NULL AND dst <> src),
least AS (SELECT src, dst, min(seconds) AS seconds FROM edges GROUP BY src, dst),
places AS (SELECT p_partkey AS node, CAST(2600000 + p_partkey % 500 * 97 AS INT) AS easting, CAST(1200000 + floor(p_partkey / 500::DOUBLE) * 97 AS INT) AS northing FROM part)
"""


def _reach_sql(searches: str) -> str:
    return f"""searches AS ({searches}),
dist(search, node, seconds) USING KEY (search, node) AS (
  SELECT search, origin, 0 FROM searches
  UNION
  SELECT o.search, o.node, o.seconds FROM (SELECT d.search, e.dst AS node, min(d.seconds + e.seconds) AS seconds FROM dist d JOIN least e ON e.src = d.node JOIN searches q ON q.search = d.search
    WHERE d.seconds + e.seconds <= q.budget GROUP BY d.search, e.dst) o LEFT JOIN recurring.dist r ON r.search = o.search AND r.node = o.node WHERE r.seconds IS NULL OR o.seconds < r.seconds)"""


ONE_SQL = f"SELECT 0 AS search, {ORIGIN} AS origin, {BUDGET} AS budget"
BATCH_SQL = f"SELECT p_partkey AS search, p_partkey AS origin, 20 AS budget FROM part WHERE p_partkey % {EVERY} = 0"
TREE_SQL = f"tree AS (SELECT e.dst, min(e.src) AS src, arg_min(e.seconds, e.src) AS seconds FROM least e JOIN dist a ON a.node = e.src JOIN dist b ON b.node = e.dst WHERE a.seconds + e.seconds = b.seconds AND e.dst <> {ORIGIN} GROUP BY e.dst)"


WEAK_SQL = """links AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
comp(node, component) USING KEY (node) AS (
  SELECT DISTINCT u, u FROM links
  UNION
  SELECT b.v, min(c.component) FROM comp c JOIN links b ON b.u = c.node JOIN recurring.comp r ON r.node = b.v WHERE c.component < r.component GROUP BY b.v)"""

#: The component of the node with most edges is what it reaches and what reaches it; the others come from the closure of what is left.
STRONG_SQL = """arcs AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges),
hub AS (SELECT src AS node FROM arcs GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
fwd(node) AS (SELECT node FROM hub UNION SELECT a.dst FROM fwd f JOIN arcs a ON a.src = f.node),
bwd(node) AS (SELECT node FROM hub UNION SELECT a.src FROM bwd f JOIN arcs a ON a.dst = f.node),
big AS MATERIALIZED (SELECT node FROM fwd INTERSECT SELECT node FROM bwd),
rest AS MATERIALIZED (SELECT a.src, a.dst FROM arcs a ANTI JOIN big x ON x.node = a.src ANTI JOIN big y ON y.node = a.dst),
closure(a, b) AS (SELECT src, dst FROM rest UNION SELECT c.a, s.dst FROM closure c JOIN rest s ON s.src = c.b),
nodes AS (SELECT src AS node FROM arcs UNION SELECT dst FROM arcs),
strong AS (SELECT node, (SELECT min(node) FROM big) AS component FROM big UNION ALL
  SELECT n.node, least(n.node, coalesce(min(c.b), n.node)) FROM nodes n ANTI JOIN big USING (node) LEFT JOIN (SELECT x.a, x.b FROM closure x JOIN closure y ON y.a = x.b AND y.b = x.a) c ON c.a = n.node GROUP BY n.node)"""


def _sql(tail: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([EDGE_SQL, *parts]) + "\n" + tail


#: A small export: (way, class, oneway, maxspeed, nodes); node 99 is missing, nodes 3 and 4 coincide.
WAYS = (
    (1, "motorway", None, None, (1, 2, 3)),
    (2, "residential", None, "50 mph", (3, 4, 5)),
    (3, "primary", "-1", "60", (5, 6)),
    (4, "motorway", "no", "none", (6, 7)),
    (5, "tertiary", "yes", None, (7, 99, 8)),
    (6, "track", None, "0", (8, 1)),
    (7, "living_street", "reversible", " 30 ", (2, 7)),
    (8, "secondary_link", None, "1.5", (1,)),
)


def _ways(spark: SparkSession) -> DataFrame:
    rows = [(w, list(nodes), {k: v for k, v in (("highway", h), ("oneway", o), ("maxspeed", m)) if v is not None}) for w, h, o, m, nodes in WAYS]
    return spark.createDataFrame(rows, "way bigint, nodes array<bigint>, tags map<string,string>")


def _nodes(spark: SparkSession) -> DataFrame:
    at = spark.range(1, 9).withColumn("k", F.when(F.col("id") == 4, 3).otherwise(F.col("id")))
    return at.select(F.col("id").alias("node"), (46.9 + F.col("k") * 0.004).alias("lat"), (7.4 + F.col("k") * 0.003).alias("lon"))


def road_speed_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.col("tags")
    return _ways(spark).select("way", speed_kmh(tags["highway"], tags["maxspeed"]).alias("kmh"), direction(tags["highway"], tags["oneway"]).cast("bigint").alias("direction"))


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rb.directed_edges(rb.measured(rb.way_segments(_ways(spark)), rb.placed(_nodes(spark))))
    return edges.select("src", "dst", F.round("seconds", 6).alias("seconds"))


def road_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, at = rb.way_segments(_ways(spark)), rb.placed(_nodes(spark))
    lost = rb.dangling(segments, at).agg(F.count("*").alias("n_dangling"))
    return lost.join(rb.measured(segments, at).agg(F.count_if(F.col("metres") == 0).alias("n_zero")))


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, ORIGIN, BUDGET)], "search int, origin bigint, budget int")


def _reached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = materialize(fixtures.road_edges(spark, sf_dir), "edges")
    return shortest_path.shortest_paths(edges, _one(spark)), edges


def road_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir)[0].select("node", F.col("seconds").cast("bigint").alias("seconds"))


def road_reach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = read(spark, sf_dir, "part").where(F.pmod("p_partkey", F.lit(EVERY)) == 0)
    searches = origins.select(F.col("p_partkey").alias("search"), F.col("p_partkey").alias("origin"), F.lit(20).alias("budget"))
    found = shortest_path.shortest_paths(fixtures.road_edges(spark, sf_dir), searches)
    return found.select("search", "node", F.col("seconds").cast("bigint").alias("seconds"))


def road_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached, edges = _reached(spark, sf_dir)
    return shortest_path.tree_edges(reached, edges, _one(spark)).select("src", "dst", F.col("seconds").cast("bigint").alias("seconds"))


def route_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached, edges = _reached(spark, sf_dir)
    tree = shortest_path.tree_edges(reached, edges, _one(spark))
    targets = reached.select("search", F.col("node").alias("dest"))
    return shortest_path.routes_to(tree, targets, _one(spark)).select("dest", F.col("seq").cast("bigint").alias("seq"), "src", "dst", F.col("seconds").cast("bigint").alias("seconds"))


def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(fixtures.road_edges(spark, sf_dir))


def weak_components_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins alone, as large graphs are solved."""
    return components.connected_components(fixtures.road_edges(spark, sf_dir), local_edges=0)


def strong_components_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.strong_components(fixtures.road_edges(spark, sf_dir), local_edges=0)


def component_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = components.component_sizes(weak_components(spark, sf_dir))
    return sizes.agg(F.count_if(F.col("size") < rb.LEAST_WEAK).alias("n_dropped"), F.coalesce(F.sum(F.when(F.col("size") < rb.LEAST_WEAK, F.col("size"))), F.lit(0)).cast("bigint").alias("n_nodes_dropped"), F.count("*").alias("n_components"))


def kept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.in_large_components(weak_components(spark, sf_dir), rb.LEAST_WEAK)


def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = materialize(kept_nodes(spark, sf_dir), "kept")
    edges = fixtures.road_edges(spark, sf_dir)
    return edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "seconds")


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.strong_components(fixtures.road_edges(spark, sf_dir))


def origin_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = materialize(strong_components(spark, sf_dir), "strong")
    good = components.in_large_components(labelled, rb.LEAST_STRONG).withColumn("origin_eligible", F.lit(True))
    return labelled.join(good, "node", "left").select("node", F.coalesce("origin_eligible", F.lit(False)).alias("origin_eligible"))


def eligible_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = origin_eligible(spark, sf_dir)
    return flags.agg(F.count_if("origin_eligible").alias("n_eligible"), F.round(F.avg(F.col("origin_eligible").cast("int")) * 100, 6).alias("percent"))


def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return snapshots.edge_offsets(fixtures.road_edges(spark, sf_dir), nodes)


def road_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached, edges = _reached(spark, sf_dir)
    tree = shortest_path.tree_edges(reached, edges, _one(spark))
    found = places.road_tips(reached, tree, fixtures.road_places(spark, sf_dir), _one(spark))
    return found.select("cell_e", "cell_n", "node", F.col("seconds").cast("bigint").alias("seconds"))


def nearest_road_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = materialize(origin_eligible(spark, sf_dir).where("origin_eligible").select("node"), "flags")
    points = fixtures.road_places(spark, sf_dir).join(flags, "node", "left_semi")
    clicks = spark.range(20).select(F.col("id").cast("int").alias("target"), (2600011 + F.col("id") * 1237).cast("int").alias("easting"), (1200013 + F.col("id") * 17).cast("int").alias("northing"))
    return places.nearest(points, clicks, "node")


QUERIES = {f.__name__: f for f in (road_speed_direction, road_edges, road_skipped, road_reach, road_reach_batch, road_tree, route_to, weak_components, weak_components_shuffled, component_totals, kept_nodes, kept_edges, strong_components, strong_components_shuffled, origin_eligible, eligible_share, csr_offsets, road_tips, nearest_road_node)}


def _way_rows() -> str:
    q = lambda x: "NULL" if x is None else f"'{x}'"
    ways = ", ".join(f"({w}, {q(h)}, {q(o)}, {q(m)}, [{', '.join(map(str, nodes))}]::BIGINT[])" for w, h, o, m, nodes in WAYS)
    from stridemap.functions.roads import CLASS_SPEEDS

    speeds = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CLASS_SPEEDS.items())
    return f"""WITH ways(way, highway, oneway, maxspeed, nodes) AS (VALUES {ways}),
tagged AS (SELECT way, nodes, CAST(CASE WHEN coalesce(try_cast(trim(maxspeed) AS DOUBLE), 0) > 0 THEN try_cast(trim(maxspeed) AS DOUBLE) ELSE CASE highway {speeds} ELSE 50 END END AS DOUBLE) AS kmh,
  CASE WHEN oneway = 'yes' THEN 1 WHEN oneway = '-1' THEN -1 WHEN oneway = 'no' THEN 0 WHEN highway IN ('motorway', 'motorway_link') THEN 1 ELSE 0 END AS direction FROM ways),
spots AS (SELECT i AS node, ((46.9::DOUBLE + CASE WHEN i = 4 THEN 3 ELSE i END * 0.004::DOUBLE) * 3600 - 169028.66::DOUBLE) / 10000 AS y, ((7.4::DOUBLE + CASE WHEN i = 4 THEN 3 ELSE i END * 0.003::DOUBLE) * 3600 - 26782.5::DOUBLE) / 10000 AS x FROM range(1, 9) r(i)),
placed AS (SELECT node,
  floor(2600072.37::DOUBLE + 211455.93::DOUBLE * x + -10938.51::DOUBLE * x * y + -0.36::DOUBLE * x * y * y + -44.54::DOUBLE * x * x * x + 0.5::DOUBLE) AS e,
  floor(1200147.07::DOUBLE + 308807.95::DOUBLE * y + 3745.25::DOUBLE * x * x + 76.63::DOUBLE * y * y + -194.56::DOUBLE * x * x * y + 119.79::DOUBLE * y * y * y + 0.5::DOUBLE) AS n FROM spots),
segments AS (SELECT way, kmh, direction, nodes[k] AS a, nodes[k + 1] AS b FROM tagged, LATERAL (SELECT unnest(range(1, len(nodes))) AS k)),
measured AS (SELECT s.*, sqrt((q.e - p.e) ** 2 + (q.n - p.n) ** 2) AS metres FROM segments s JOIN placed p ON p.node = s.a JOIN placed q ON q.node = s.b)
"""


ORACLES = {
    "road_speed_direction": _way_rows() + "SELECT way, kmh, CAST(direction AS BIGINT) AS direction FROM tagged",
    "road_edges": _way_rows() + "SELECT a AS src, b AS dst, round(metres / (kmh * 1000 / 3600), 6) AS seconds FROM measured WHERE metres > 0 AND direction >= 0 UNION ALL SELECT b, a, round(metres / (kmh * 1000 / 3600), 6) FROM measured WHERE metres > 0 AND direction <= 0",
    "road_skipped": _way_rows() + "SELECT (SELECT count(*) FROM segments) - (SELECT count(*) FROM measured) AS n_dangling, (SELECT count(*) FROM measured WHERE metres = 0) AS n_zero",
    "road_reach": _sql("SELECT node, CAST(seconds AS BIGINT) AS seconds FROM dist", _reach_sql(ONE_SQL)),
    "road_reach_batch": _sql("SELECT search, node, CAST(seconds AS BIGINT) AS seconds FROM dist", _reach_sql(BATCH_SQL)),
    "road_tree": _sql("SELECT src, dst, CAST(seconds AS BIGINT) AS seconds FROM tree", _reach_sql(ONE_SQL), TREE_SQL),
    "route_to": _sql(
        "SELECT dest, max(back) OVER (PARTITION BY dest) - back AS seq, src, dst, CAST(seconds AS BIGINT) AS seconds FROM walk",
        _reach_sql(ONE_SQL), TREE_SQL,
        "walk AS (SELECT dst AS dest, 0 AS back, src, dst, seconds FROM tree UNION ALL SELECT w.dest, w.back + 1, t.src, t.dst, t.seconds FROM walk w JOIN tree t ON t.dst = w.src)",
    ),
    "weak_components": _sql("SELECT node, component FROM comp", WEAK_SQL),
    "weak_components_shuffled": _sql("SELECT node, component FROM comp", WEAK_SQL),
    "component_totals": _sql("SELECT count(*) FILTER (n < 10) AS n_dropped, CAST(coalesce(sum(n) FILTER (n < 10), 0) AS BIGINT) AS n_nodes_dropped, count(*) AS n_components FROM (SELECT component, count(*) AS n FROM comp GROUP BY component)", WEAK_SQL),
    "kept_nodes": _sql("SELECT node FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) >= 10)", WEAK_SQL),
    "kept_edges": _sql("SELECT e.src, e.dst, e.seconds FROM edges e WHERE e.src IN (SELECT node FROM kept) AND e.dst IN (SELECT node FROM kept)", WEAK_SQL, "kept AS (SELECT node FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) >= 10))"),
    "strong_components": _sql("SELECT node, component FROM strong", STRONG_SQL),
    "strong_components_shuffled": _sql("SELECT node, component FROM strong", STRONG_SQL),
    "origin_eligible": _sql("SELECT node, count(*) OVER (PARTITION BY component) >= 20 AS origin_eligible FROM strong", STRONG_SQL),
    "eligible_share": _sql("SELECT count(*) FILTER (f) AS n_eligible, round(avg(CAST(f AS INT)) * 100, 6) AS percent FROM (SELECT count(*) OVER (PARTITION BY component) >= 20 AS f FROM strong)", STRONG_SQL),
    "csr_offsets": _sql("SELECT p.node, CAST(coalesce(sum(d) OVER (ORDER BY p.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, d AS degree FROM (SELECT p.node, count(e.src) AS d FROM places p LEFT JOIN edges e ON e.src = p.node GROUP BY p.node) p"),
    "road_tips": _sql(
        "SELECT cell_e, cell_n, node, CAST(seconds AS BIGINT) AS seconds FROM (SELECT CAST(floor(easting / 400.0::DOUBLE) AS INT) AS cell_e, CAST(floor(northing / 400.0::DOUBLE) AS INT) AS cell_n, d.node, d.seconds FROM dist d JOIN places USING (node) "
        f"WHERE d.node NOT IN (SELECT src FROM tree) AND {BUDGET} - d.seconds <= 180) QUALIFY row_number() OVER (PARTITION BY cell_e, cell_n ORDER BY seconds DESC, node) = 1", _reach_sql(ONE_SQL), TREE_SQL),
    "nearest_road_node": _sql(
        "SELECT target, node, CAST(d2 AS BIGINT) AS d2 FROM (SELECT i AS target, p.node, (CAST(easting AS BIGINT) - (2600011 + i * 1237)) ** 2 + (CAST(northing AS BIGINT) - (1200013 + i * 17)) ** 2 AS d2 FROM places p JOIN good USING (node), range(20) r(i)) QUALIFY row_number() OVER (PARTITION BY target ORDER BY d2, node) = 1",
        STRONG_SQL, "good AS (SELECT node FROM (SELECT node, count(*) OVER (PARTITION BY component) AS n FROM strong) WHERE n >= 20)"),
}
