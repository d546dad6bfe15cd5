"""Closures look at each segment once per key, without dealing segments times keys anew."""

from __future__ import annotations

import pytest

from causeway.operators import access
from causeway.plans import bindings, case_queries, road_queries

DATA = "/root/testdata/sf0.001"
QUERIES = {**road_queries.QUERIES, **case_queries.QUERIES}
#: Queries over all closures.
OVER_CLOSURES = ["closure_ids", "closure_index_audit", "closure_reasons", "export_row"]


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("name", OVER_CLOSURES)
def test_crossed_rows_are_not_dealt_by_segment(spark, name):
    plan = _plan(QUERIES[name](spark, DATA))
    cross = next(k for k, line in enumerate(plan) if "BroadcastNestedLoopJoin" in line)
    assert not any("Exchange hashpartitioning(segment_id" in line for line in plan[:cross])


def test_lookup_writes_closures_without_a_shuffle(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(access, "judged", lambda *args, f=access.judged, **kw: plans.append(f(*args, **kw)) or plans[-1])
    rows = road_queries.scenario_lookup(spark, DATA)
    assert rows.count() > 0 and len(plans) == 1
    assert not any("hashpartitioning" in line for line in _plan(plans[0]))


@pytest.fixture(scope="module")
def joined(spark):
    segments = spark.createDataFrame([("a", 100.0, False, False), ("b", 100.0, True, False), ("c", 100.0, False, True), ("d", 9.0, False, False)], "segment_id string, length_m double, bridge boolean, tunnel boolean")
    evidence = spark.createDataFrame([("b", 100.0, 20.0), ("c", 100.0, 100.0), ("d", 9.0, 9.0)], "segment_id string, within_tile_m double, retained_m double")
    water = spark.createDataFrame([("b", "wet", 25.0, 0.0), ("c", "wet", 90.0, 90.0), ("d", "dry", 9.0, 9.0), ("b", "dry", 16.0, 15.0)], "segment_id string, scenario_id string, supported_water_m double, retained_water_m double")
    return segments, evidence, water


def test_closures_plan_and_words(spark, joined):
    grid = access.policy_grid(spark, ["wet", "dry"])
    closed = access.closures(*joined, grid)
    plan = _plan(closed)
    cross = next(k for k, line in enumerate(plan) if "BroadcastNestedLoopJoin" in line)
    assert not any("hashpartitioning" in line for line in plan[:cross])
    names = sorted([r["scenario_key"] for r in grid.collect()] + ["baseline"] + [f"none {k}" for k in range(70)])  # more than one word
    rows = access.shut_words(access.known(*joined), grid, names).collect()
    found = {(names[63 * w + k], r["segment_id"]) for r in rows for w, word in enumerate(r["shut"]) for k in range(63) if word >> k & 1}
    assert len(rows) == 4 and found == {(r["scenario_key"], r["segment_id"]) for r in closed.collect()}


def test_marks_give_what_joins_give(spark):
    segments = road_queries._segments(spark, DATA)
    seen, water = bindings.evidence(spark, DATA, segments)
    grid = access.policy_grid(spark, list(bindings.SCENARIOS))
    one, other = access.closures(segments, seen, water, grid), access.judged(bindings.known(segments), grid)
    assert one.count() == other.count() > 0 and one.exceptAll(other).isEmpty()
