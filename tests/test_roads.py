from __future__ import annotations

import random

import pytest

from stridemap.operators import components
from stridemap.operators.places import isochrone
from stridemap.operators.shortest_path import routes_to, shortest_paths, tree_edges
from stridemap.plans import road_build as rb
from stridemap.sources import osm, snapshots


def graph(spark, edges):
    return spark.createDataFrame([(a, b, float(s)) for a, b, s in edges], "src bigint, dst bigint, seconds float")


def one(spark, origin, budget):
    return spark.createDataFrame([(0, origin, budget)], "search int, origin bigint, budget int")


CHAIN = [(0, 1, 100), (1, 2, 100), (2, 3, 100)]


def reached(spark, edges, origin, budget):
    return {r["node"]: r["seconds"] for r in shortest_paths(graph(spark, edges), one(spark, origin, budget)).collect()}


def test_horizon(spark):
    assert reached(spark, CHAIN, 0, 250) == {0: 0, 1: 100, 2: 200}


def test_shorter_path_and_tree(spark):
    edges = [(0, 2, 100), (0, 1, 10), (1, 2, 10), (0, 1, 30)]
    found = shortest_paths(graph(spark, edges), one(spark, 0, 1000))
    assert {r["node"]: r["seconds"] for r in found.collect()} == {0: 0, 1: 10, 2: 20}
    tree = tree_edges(found, graph(spark, edges), one(spark, 0, 1000))
    assert {(r["src"], r["dst"], r["seconds"]) for r in tree.collect()} == {(0, 1, 10), (1, 2, 10)}


def test_one_way(spark):
    assert reached(spark, [(0, 1, 50)], 1, 1000) == {1: 0}


def test_budget_met_exactly_and_empty_graph(spark):
    assert reached(spark, CHAIN, 0, 100) == {0: 0, 1: 100}
    assert shortest_paths(graph(spark, CHAIN).limit(0), one(spark, 0, 100)).count() == 1


def test_routes(spark):
    edges, asked = graph(spark, CHAIN), one(spark, 0, 250)
    found = shortest_paths(edges, asked)
    tree = tree_edges(found, edges, asked)
    targets = spark.createDataFrame([(0, 0), (0, 2), (0, 3)], "search int, dest bigint")
    rows = sorted((r["dest"], r["seq"], r["src"], r["dst"], r["seconds"]) for r in routes_to(tree, targets, asked).collect())
    assert rows == [(2, 0, 0, 1, 100), (2, 1, 1, 2, 100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_agree(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    frame = spark.createDataFrame(pairs, "src bigint, dst bigint")
    near = {r["node"]: r["component"] for r in components.strong_components(frame).collect()}
    far = {r["node"]: r["component"] for r in components.strong_components(frame, local_edges=0).collect()}
    assert near == far
    weak = {r["node"]: r["component"] for r in components.connected_components(frame, local_edges=0).collect()}
    assert weak == {r["node"]: r["component"] for r in components.connected_components(frame).collect()}
    assert all(weak[a] == weak[b] for a, b in pairs if a != b)
    assert all(weak[n] == weak[near[n]] for n in weak)  # a strong component lies in a weak one


def test_build_from_an_export(spark, tmp_path):
    import json

    ring = list(range(100, 120))
    nodes = [{"type": "node", "id": n, "lat": 46.9 + k * 0.001, "lon": 7.4 + (k % 5) * 0.001} for k, n in enumerate(ring)]
    nodes += [{"type": "node", "id": 200 + k, "lat": 47.1 + k * 0.001, "lon": 7.5} for k in range(9)]
    nodes += [{"type": "node", "id": 300, "lat": 46.95, "lon": 7.45}]
    ways = [
        {"type": "way", "id": 1, "nodes": [*ring, ring[0]], "tags": {"highway": "residential", "oneway": "yes"}},
        {"type": "way", "id": 2, "nodes": [ring[0], 300], "tags": {"highway": "motorway"}},
        {"type": "way", "id": 3, "nodes": [200 + k for k in range(9)], "tags": {"highway": "primary"}},
        {"type": "way", "id": 4, "nodes": [ring[0], 999], "tags": {"highway": "primary"}},
    ]
    (tmp_path / "export.json").write_text(json.dumps({"elements": nodes + ways}))
    points, lines = osm.read_export(spark, str(tmp_path / "export.json"))
    at, segments = rb.placed(points), rb.way_segments(lines)
    assert rb.dangling(segments, at).count() == 1
    kept, edges = rb.road_network(rb.directed_edges(rb.measured(segments, at)), at)
    flags = {r["node"]: r["origin_eligible"] for r in kept.collect()}
    assert set(flags) == {*ring, 300} and not flags[300] and all(flags[n] for n in ring)  # nine nodes are dropped, a one-way stub is no origin
    assert edges.count() == 21


def test_packed_roads_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 10, -5, True), (1, 20, 7, False), (2, 30, 8, True)], "node bigint, easting int, northing int, origin_eligible boolean")
    edges = graph(spark, [(0, 1, 1.5), (0, 2, 2.25), (2, 0, 3)])
    snapshots.write_packed_roads(nodes, edges, str(tmp_path / "packed"))
    got_nodes, got_edges = snapshots.read_packed_roads(spark, str(tmp_path / "packed"))
    assert {tuple(r) for r in got_nodes.collect()} == {tuple(r) for r in nodes.collect()}
    assert {tuple(r) for r in got_edges.collect()} == {(0, 1, 1.5), (0, 2, 2.25), (2, 0, 3.0)}
    raw = (tmp_path / "packed" / "nodes.bin").read_bytes()
    assert raw[:8] == (10).to_bytes(4, "big", signed=True) + (-5).to_bytes(4, "big", signed=True)
    assert (tmp_path / "packed" / "edge-offsets.bin").read_bytes()[4:8] == (2).to_bytes(4, "little")


def test_isochrone_covers_the_circle(spark):
    sources = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 3600.0)], "search int, x double, y double, elapsed double, budget double")
    full, cut = (isochrone(sources, skewed=s) for s in (False, True))
    found = {(r["q"], r["r"]): r["elapsed"] for r in full.collect()}
    size, radius = 180, 3600 * 1.2
    want = set()
    for r in range(-40, 41):
        for q in range(-60, 61):
            x, y = size * 3**0.5 * (q + r / 2), size * 1.5 * r
            if (x * x + y * y) ** 0.5 <= radius:
                want.add((q, r))
    assert set(found) == want and found[(0, 0)] == 0
    assert cut.count() < len(want)


def test_nearest_of_none_and_of_many(spark):
    from stridemap.operators.places import nearest

    rng = random.Random(4)
    points = [(k, rng.randrange(100_000), rng.randrange(3_000)) for k in range(400)] + [(900, 5, 5), (901, 5, 5), (902, None, 1)]
    clicks = [(k, rng.randrange(-900_000, 900_000), rng.randrange(-50_000, 50_000)) for k in range(11_000)] + [(20_000, 5, 5), (20_001, None, 3)]
    at = spark.createDataFrame(points, "node bigint, easting int, northing int")
    asked = spark.createDataFrame(clicks, "target int, easting int, northing int")
    got = {r["target"]: (r["d2"], r["node"]) for r in nearest(at, asked, "node").collect()}
    known = [p for p in points if p[1] is not None]
    for target, e, n in [*clicks[::97], clicks[-2]]:
        assert got[target] == min(((x - e) ** 2 + (y - n) ** 2, node) for node, x, y in known)
    assert len(got) == 11_001 and got[20_000] == (0, 900)
    assert nearest(at, asked.where("false"), "node").count() == 0 and nearest(at.where("false"), asked, "node").count() == 0


def test_long_routes_by_doubling(spark):
    from stridemap.operators.shortest_path import routes_to

    n = 75
    tree = spark.createDataFrame([(0, k, k + 1, 1.0) for k in range(n)], "search int, src bigint, dst bigint, seconds double")
    targets = spark.createDataFrame([(0, n), (0, 3), (0, 0), (0, 999)], "search int, dest bigint")
    got = routes_to(tree, targets, spark.createDataFrame([(0, 0, 9)], "search int, origin bigint, budget int")).collect()
    assert sorted((r["dest"], r["seq"], r["src"], r["dst"]) for r in got) == [(d, k, k, k + 1) for d in (3, n) for k in range(d)]
