"""Road graphs, shortest paths, closures and access on hand-made inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from causeway.contracts import ContractError, require, require_unique
from causeway.operators import access, graph, spatial


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame([("A", "H", 10.0, "exposed"), ("A", "B", 8.0, "clear"), ("B", "H", 9.0, "unknown"), ("C", "H", 6.0, "clear")], "source string, target string, cost double, state string")


@pytest.mark.parametrize("policy, costs", [("baseline", (10.0, 9.0, 6.0)), ("exposed_only", (17.0, 9.0, 6.0)), ("conservative", (None, None, 6.0))])
def test_demo_costs(demo, policy, costs):
    assert tuple(graph.cheapest(demo, o, "H", policy) for o in "ABC") == costs


def test_demo_direction_and_errors(demo):
    assert graph.cheapest(demo, "H", "A") is None
    assert graph.cheapest(demo, "H", "H") == 0.0
    with pytest.raises(ValueError):
        graph.cheapest(demo, "A", "Z")
    with pytest.raises(ValueError):
        graph.cheapest(demo, "A", "H", "whatever")


@pytest.fixture(scope="module")
def road_graph(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 900.0), (3, 0.0, 900.0), (4, 900.0, 0.0), (5, 1800.0, 900.0)], "node_id long, x_m double, y_m double")
    ways = spark.createDataFrame([(10, [1, 2, 5], {"highway": "residential", "oneway": "yes"}), (11, [3, 4], {"highway": "residential", "bridge": "yes", "layer": "1"}), (12, [1, 3], {"highway": "track"})], "way_id long, nodes array<long>, tags map<string,string>")
    return nodes, ways


def test_graph_of_shared_nodes(spark, road_graph):
    nodes, ways = road_graph
    segments = graph.segments(ways, nodes)
    edges = graph.directed(segments)
    assert edges.count() == 4
    parts = {r["node"]: r["component"] for r in graph.weak_components(edges).collect()}
    assert parts == {1: 1, 2: 1, 5: 1, 3: 3, 4: 3}
    goal = spark.createDataFrame([("g", 5)], "facility_id string, node long")
    assert {r["node"] for r in graph.nearest_facility(edges, goal).collect()} == {1, 2, 5}
    assert {r["reject_reason"] for r in graph.rejections(ways).collect()} == {"class_outside_contract"}


def test_crossing_without_junction(road_graph):
    nodes, ways = road_graph
    found = spatial.crossings(graph.segments(ways, nodes), cell=500.0).collect()
    assert [(r["left_id"], r["right_id"], r["grade_tagged"]) for r in found] == [("osm:10:0", "osm:11:0", True)]


@pytest.mark.parametrize("tags, direction, source", [({"highway": "motorway"}, 1, "inferred_one_way"), ({"highway": "service", "oneway": "reversible"}, None, "unsupported_oneway:reversible"), ({"highway": "service", "oneway": "-1"}, -1, "explicit_reverse")])
def test_travel_direction(spark, tags, direction, source):
    row = spark.createDataFrame([(1, [1, 2], tags)], "way_id long, nodes array<long>, tags map<string,string>")
    got = graph.judged_ways(row).first()["way_direction"]
    assert (got["direction"], got["source"]) == (direction, source)


@pytest.mark.parametrize("text, kmh", [("50", 50.0), ("30 mph", 30 * 1.609344), ("walk", 30.0), ("3", 30.0), ("", 30.0)])
def test_speed(spark, text, kmh):
    row = spark.createDataFrame([(1, [1, 2], {"highway": "residential", "maxspeed": text})], "way_id long, nodes array<long>, tags map<string,string>")
    assert graph.judged_ways(row).first()["way_speed"]["kmh"] == pytest.approx(kmh)


@pytest.fixture(scope="module")
def case(spark):
    edges = spark.createDataFrame([("a1", "a", 1, 2, 5.0), ("b1", "b", 2, 3, 5.0), ("c1", "c", 1, 3, 20.0)], "edge_id string, segment_id string, source long, target long, cost_seconds double")
    segments = spark.createDataFrame([("a", 100.0, False, False), ("b", 100.0, True, False), ("c", 100.0, False, False)], "segment_id string, length_m double, bridge boolean, tunnel boolean")
    evidence = spark.createDataFrame([("b", 100.0, 20.0)], "segment_id string, within_tile_m double, retained_m double")
    water = spark.createDataFrame([("b", "wet", 25.0, 0.0)], "segment_id string, scenario_id string, supported_water_m double, retained_water_m double")
    grid = access.policy_grid(spark, ["wet"])
    closed = access.closures(segments, evidence, water, grid)
    return edges, grid, closed


def test_closures_by_policy(case):
    _, _, closed = case
    by_key: dict[str, set] = {}
    for r in closed.collect():
        by_key.setdefault(r["scenario_key"], set()).add(r["segment_id"])
    assert "wet|supported_overlap|bridge_exempt" not in by_key
    assert by_key["wet|supported_overlap|bridge_candidate"] == {"b"}
    assert "wet|retained_overlap|bridge_candidate" not in by_key
    assert by_key["wet|supported_plus_all_unknown|bridge_candidate"] == {"a", "b", "c"}


def test_paired_access(spark, case):
    edges, grid, closed = case
    goal = spark.createDataFrame([("h", 3)], "facility_id string, node long")
    origins = spark.createDataFrame([("o", 1), ("isolated", 2)], "origin_id string, node long")
    base = graph.nearest_facility(edges, goal)
    solved = graph.nearest_facility(edges, goal, closed=closed.select("scenario_key", "segment_id"), scenarios=grid.select("scenario_key"))
    rows = access.access_rows(origins, grid, base, solved)
    got = {(r["scenario_key"], r["origin_id"]): r for r in rows.collect()}
    one = got["wet|supported_overlap|bridge_candidate", "o"]
    assert (one["baseline_cost_seconds"], one["estimated_cost_seconds"], one["cost_delta_seconds"]) == (10.0, 20.0, 10.0)
    lost = got["wet|supported_overlap|bridge_candidate", "isolated"]
    assert lost["estimated_cost_seconds"] is None and lost["newly_disconnected"] and lost["reason"] == "no_graph_path"
    summary = {r["scenario_key"]: r for r in access.summarise(rows, ["scenario_key"]).collect()}
    assert summary["wet|supported_overlap|bridge_candidate"]["newly_disconnected"] == 1
    assert all(r["improved"] == 0 for r in summary.values())


def test_cheaper_closures_and_incomplete_origins_raise(spark):
    rows = spark.createDataFrame(
        [("k", "o2", 5.0, 1.0, False), ("k", "o1", None, None, True), ("k", "o3", None, None, True), ("n", "o1", 6.0, 2.0, False)],
        "scenario_key string, origin_id string, estimated_cost_seconds double, cost_delta_seconds double, newly_disconnected boolean",
    ).withColumn("baseline_unreachable", F.lit(False))
    assert {tuple(r) for r in access.first_disconnected(rows, ["scenario_key"]).collect()} == {("k", "o1"), ("n", None)}
    assert access.summarise(rows, ["scenario_key"]).filter("scenario_key = 'k'").first()["mean_increase_seconds"] == 1.0
    lower = rows.withColumn("cost_delta_seconds", F.col("cost_delta_seconds") - 1.5)
    with pytest.raises(Exception, match="1 origins have a negative increase"):
        access.summarise(lower, ["scenario_key"]).collect()
    origins = spark.createDataFrame([("o1", 1), ("o2", 2)], "origin_id string, node long")
    nodes = spark.createDataFrame([(1, 0.0, 1.0), (2, 3.0, 4.0), (9, 0.0, 0.0), (9, 0.0, 0.0)], "node_id long, x_m double, y_m double")
    base = spark.createDataFrame([(2, 4.0)], "node long, cost_seconds double")
    ranges = access.stability(rows)
    got = {r["origin_id"]: (r["x_m"], r["baseline_cost_seconds"], r["reachable_members"]) for r in access.origin_overview(origins, nodes, base, ranges).collect()}
    assert got == {"o1": (0.0, None, 1), "o2": (3.0, 4.0, 1)}
    for o, n, s in ((origins, nodes.filter("node_id > 1"), ranges), (origins, nodes, ranges.filter("origin_id = 'o1'")), (origins, nodes.union(nodes), ranges)):
        with pytest.raises(ContractError):
            access.origin_overview(o, n, base, s)


def test_path_walk(spark, case):
    edges, _, _ = case
    goal = spark.createDataFrame([("h", 3)], "facility_id string, node long")
    solved = graph.nearest_facility(edges, goal)
    hops = graph.next_edges(solved, edges).filter("node <> 3").select("node", "target")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 10.0, 10.0)], "node_id long, x_m double, y_m double")
    starts = spark.createDataFrame([("o", 1)], "origin_id string, node long")
    row = graph.path_audit(starts, hops, nodes).first()
    assert (row["end_node"], row["hops"], row["border_m"]) == (3, 2, 0.0)


def test_snap_ties_and_limit(spark):
    nodes = spark.createDataFrame([(7, 1.0, 0.0), (3, -1.0, 0.0)], "node_id long, x_m double, y_m double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0)], "point_id long, x_m double, y_m double")
    got = {r["point_id"]: (r["status"], r["nearest_node_id"]) for r in spatial.snap(points, nodes, limit_m=5.0).collect()}
    assert got == {1: ("snapped", 3), 2: ("beyond_snap_limit", None)}


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None)], "k int, v double")
    with pytest.raises(ContractError, match="positive: 1 rows"):
        require(df, {"positive": F.col("v") > 0})
    with pytest.raises(ContractError):
        require_unique(df, "k")


@pytest.mark.parametrize("cost, state, source", [(-1.0, "clear", "A"), (float("nan"), "clear", "A"), (float("inf"), "clear", "A"), (None, "clear", "A"), (1.0, "flooded", "A"), (1.0, "clear", "")])
def test_broken_demo_edges_raise(spark, cost, state, source):
    edges = spark.createDataFrame([("A", "H", 1.0, "clear"), (source, "H", cost, state)], "source string, target string, cost double, state string")
    with pytest.raises(ValueError):
        graph.cheapest(edges, "A", "H")


def test_broken_graphs_raise(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 30.0, 0.0)], "node_id bigint, x_m double, y_m double")
    way = lambda *ids: spark.createDataFrame([(7, list(ids), {"highway": "residential"})], "way_id bigint, nodes array<bigint>, tags map<string,string>")
    with pytest.raises(ValueError, match="way 7 names the missing node 9"):
        graph.build(way(1, 2, 9), nodes)
    with pytest.raises(ValueError, match="no edge"):
        graph.build(way(1), nodes)
    with pytest.raises(ValueError, match="position"):
        graph.build(way(1, 2), nodes.union(spark.createDataFrame([(3, float("nan"), 0.0)], nodes.schema)))
    edges = graph.build(way(1, 2), nodes)
    far = spark.createDataFrame([("f", 99), ("g", 2)], "facility_id string, node bigint")
    with pytest.raises(ValueError, match="outside the graph"):
        graph.nearest_facility(edges, far)
    assert {r["node"]: r["facility_id"] for r in graph.nearest_facility(edges, far, strict=False).collect()} == {1: "g", 2: "g"}
