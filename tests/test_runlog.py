"""Runs: one writer wins, plans stay, half-written runs are not read, damage below is reported above."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from causeway.contracts import ContractError
from causeway.operators import graph, spatial
from causeway.plans import runlog


@pytest.fixture
def log(spark, tmp_path):
    return runlog.RunLog(spark, f"file://{tmp_path}/runs")


def test_states_and_manifest(log, tmp_path):
    with pytest.raises(ContractError, match="no plan"):
        log.begin("r1")
    log.plan("r1", {"b": 1, "a": [2]})
    log.plan("r1", {"a": [2], "b": 1})  # the same plan
    with pytest.raises(runlog.Conflict):
        log.plan("r1", {"a": [3], "b": 1})
    assert log.state("r1") is None
    log.begin("r1")
    assert log.state("r1") == "running"
    with pytest.raises(ContractError, match="running"):
        log.outputs("r1")
    for bad in ("../x", "/x", "a//b", "a/./b", "a\\b", ""):
        with pytest.raises(ContractError, match="leaves"):
            log.complete("r1", {bad: "0"})
    log.complete("r1", {"roads/part": "ab"})
    assert log.outputs("r1") == {"roads/part": "ab"}
    for again in (lambda: log.complete("r1", {}), lambda: log.fail("r1", "late"), lambda: log.begin("r1")):
        with pytest.raises(runlog.Conflict):
            again()
    log.plan("r2", {})
    log.begin("r2")
    log.fail("r2", "disk")
    with pytest.raises(ContractError, match="failed"):
        log.outputs("r2")
    assert {r["run_id"]: (r["state"], r["detail"]) for r in log.entries().collect()} == {"r1": ("complete", None), "r2": ("failed", "disk")}
    (tmp_path / "runs/r1/.manifest.json.crc").unlink(missing_ok=True)
    (tmp_path / "runs/r1/manifest.json").write_text('{"roads/part":"ac"}')
    with pytest.raises(ContractError, match="not the one"):
        log.outputs("r1")
    with pytest.raises(ValueError):
        log.state("../r1")


def test_one_of_many_writers_wins(log):
    log.plan("race", {"x": 1})

    def take(_):
        try:
            log.begin("race")
            return True
        except runlog.Conflict:
            return False

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(take, range(16))) == 1


def test_damage_at_depth_three_is_reported_at_the_top(spark):
    runs = spark.createDataFrame([("top", True), ("a", True), ("b", True), ("c", False), ("free", True), ("x", True), ("y", True), ("lost", True), ("unknown", None)], "run_id string, sound boolean")
    links = spark.createDataFrame([("top", "a"), ("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("lost", "nowhere"), ("top", "free"), ("top", "free")], "run_id string, rests_on string")
    got = {r["run_id"]: (r["valid"], r["cause"], r["depth"]) for r in runlog.gates(runs, links).collect()}
    assert got["top"] == (False, "c", 3) and got["b"] == (False, "c", 1) and got["c"] == (False, "c", 0)
    assert got["lost"] == (False, "lost", 0) and got["unknown"] == (False, "unknown", 0)
    assert got["free"] == got["x"] == got["y"] == (True, None, None)


def test_gates_equal_a_walk(spark):
    rng = random.Random(3)
    sound = {k: rng.random() > 0.1 for k in range(120)}
    rests = {(a, rng.randrange(a)) for a in range(1, 120) for _ in range(rng.randint(0, 2))}
    runs = spark.createDataFrame(list(sound.items()), "run_id int, sound boolean")
    got = {r["run_id"]: (r["cause"], r["depth"]) for r in runlog.gates(runs, spark.createDataFrame(sorted(rests), "run_id int, rests_on int")).collect()}
    for k in sound:
        layer, seen, depth = {k}, {k}, 0
        while layer and all(sound[v] for v in layer):
            layer = {b for a, b in rests if a in layer} - seen
            seen |= layer
            depth += 1
        want = (min(v for v in layer if not sound[v]), depth) if layer else (None, None)
        assert (got[k][0] is None) == (want[0] is None) and got[k][1] == want[1]


def test_paths_and_snapping_refuse_bad_input(spark):
    edges = spark.createDataFrame([("e1", "s1", 1, 2, 3.0), ("e2", "s2", 2, 1, -1.0)], "edge_id string, segment_id string, source int, target int, cost_seconds double")
    goal = spark.createDataFrame([("f", 2)], "facility_id string, node int")
    with pytest.raises(ValueError, match="negative"):
        graph.nearest_facility(edges, goal)
    fine = edges.filter("cost_seconds > 0")
    with pytest.raises(ValueError, match="no facility"):
        graph.nearest_facility(fine, goal.filter("false"))
    with pytest.raises(ValueError, match="no facility"):
        graph.nearest_facility(fine, goal.selectExpr("facility_id", "9 AS node"), strict=False)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5e6, 5e6)], "point_id int, x_m double, y_m double")
    bad = spark.createDataFrame([(1, float("nan"), 0.0)], "node_id int, x_m double, y_m double")
    with pytest.raises(ContractError, match="nodes have finite"):
        spatial.snap(points, bad, limit_m=10.0)
    one = spark.createDataFrame([(7, 0.0, 3.0)], "node_id int, x_m double, y_m double")
    got = {r["point_id"]: (r["status"], r["nearest_distance_m"]) for r in spatial.snap(points, one, limit_m=1000.0).collect()}
    assert got[1] == ("snapped", 3.0) and got[2][0] == "beyond_snap_limit" and got[2][1] == pytest.approx(7071065.69, abs=0.1)
