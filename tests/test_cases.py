"""Case study, final evaluation and contracts of sources and tiles on hand-made inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from causeway.contracts import ContractError
from causeway.functions import pixels as px
from causeway.operators import access, catalog, evaluate, order, scenarios, spatial, tiles


def _scenarios(spark):
    names = [f"threshold_{t:.2f}" for t in scenarios.THRESHOLDS] + [f"offset_seed_{s}" for s in scenarios.SEEDS]
    names += [scenarios.CASE_PRIMARY, "m3_ndwi_threshold_-0.15", "m3_ndwi_threshold_+0.05"] + [f"m3_shared_offset_seed_{s}" for s in scenarios.CASE_SEEDS]
    return spark.createDataFrame([(n,) for n in names], "scenario_id string")


def test_grid_has_92_runs(spark):
    grid = access.case_grid(_scenarios(spark), scenarios.CASE_PRIMARY)
    assert grid.count() == 92
    assert grid.filter(F.col("policy") == "supported_plus_all_unknown").select("scenario_id").distinct().collect()[0][0] == scenarios.CASE_PRIMARY


def test_display_order(spark):
    places = {r["scenario_id"]: r["place"] for r in scenarios.ordered(_scenarios(spark)).collect()}
    assert places[scenarios.CASE_PRIMARY] == 1 and places["threshold_0.50"] == 2
    assert places["m3_shared_offset_seed_608"] < places["offset_seed_501"] < places["threshold_0.35"]


def test_case_masks_keep_unknown(spark):
    rows = [("t", 0, 0, 0.04, 0.55, True), ("t", 0, 1, -0.10, 0.48, True), ("t", 0, 2, None, None, False)]
    scored = spark.createDataFrame(rows, "tile_id string, px_row long, px_col long, ndwi double, p double, eligible boolean")
    got = {(r["scenario_id"], r["px_col"]): r["value"] for r in scenarios.case_masks(scored, slope=2.5, intercept=0.2).collect()}
    assert len(got) == 22 * 3
    assert all(v is None for (_, col), v in got.items() if col == 2)
    assert [got[scenarios.CASE_PRIMARY, c] for c in (0, 1)] == [1, 0]
    assert [got["m3_ndwi_threshold_+0.05", c] for c in (0, 1)] == [0, 0] and [got["m3_ndwi_threshold_-0.15", c] for c in (0, 1)] == [1, 1]


def test_methods_count_undefined_scores_apart(spark):
    rows = [("e", 1, 0.9, True), ("e", 0, 0.9, True), ("e", 1, None, True), ("e", 0, 0.1, False)]
    df = spark.createDataFrame(rows, "event_id string, label int, s double, eligible boolean")
    row = evaluate.method_counts(df, {"m": (F.col("s"), 0.5)}, ["event_id"]).first()
    assert (row["method"], row["tp"], row["fp"], row["fn"], row["tn"], row["undefined"]) == ("m", 1, 1, 0, 0, 1)


def test_optical_conditions(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False)], "v double, inside boolean")
    read = lambda name: [tuple(r) for r in df.select(*px.observed_optics(F.col("v"), name, F.col("inside"))).collect()]
    assert read("clean") == [(1.0, True), (1.0, True)]
    assert read("missing_optical") == [(0.0, False), (0.0, False)]
    assert read("block_missing") == [(0.0, False), (1.0, True)]
    assert [round(v, 9) for v, _ in read("block_brightened")] == [1.35, 1.0]
    with pytest.raises(ValueError):
        px.observed_optics(F.col("v"), "fog", F.col("inside"))


def test_dates(spark):
    df = spark.createDataFrame([("2019/09/12",), (None,)], "d string")
    assert [r[0] for r in df.select(px.iso_date(F.col("d"))).collect()] == ["2019-09-12", None]
    with pytest.raises(Exception, match="CANNOT_PARSE|could not be parsed|INVALID"):
        spark.createDataFrame([("12 Sep",)], "d string").select(px.iso_date(F.col("d"))).collect()


def test_metadata_is_total_and_single(spark):
    chips = spark.createDataFrame([("a", "X"), ("b", "Y")], "chip string, location string")
    full = spark.createDataFrame([("X", 1), ("Y", 2)], "location string, k int")
    assert catalog.with_metadata(chips, full, "location").count() == 2
    with pytest.raises(ContractError):
        catalog.with_metadata(chips, full.filter("k = 1"), "location")
    with pytest.raises(ContractError):
        catalog.with_metadata(chips, full.union(full), "location")


def test_inventory_states(spark):
    sized = "path string, size bigint"
    listed = spark.createDataFrame([("raw/a", 1), ("raw/b", 2), ("raw/c", 3), ("raw/d", 4), ("raw/../x", 5), ("etc/y", 6)], sized)
    found = spark.createDataFrame([("raw/a", 1), ("raw/b", 9), ("raw/d", 4), ("raw/../x", 5), ("etc/y", 6)], sized)
    needed = spark.createDataFrame([("raw/a",), ("raw/b",), ("raw/c",), ("raw/e",)], "path string")
    got = {r["path"]: r["state"] for r in catalog.inventory_audit(listed, found, needed, "raw").collect()}
    assert got == {"raw/a": "complete", "raw/b": "size_differs", "raw/c": "missing", "raw/d": "not_needed", "raw/e": "not_listed", "raw/../x": "outside_root", "etc/y": "outside_root"}


def test_footprint_and_grid(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 1e-12), (20.0, 1e-6)], "shift double, wobble double")
    ref = tuple(F.lit(v) for v in (0.0, 0.0, 10.0, 10.0))
    moved = (ref[0] + F.col("shift"), ref[1], ref[2] + F.col("shift"), ref[3])
    affine = [0.1, 0.0, 0.0, 0.0, -0.1, 10.0]
    other = F.array(*[F.lit(v) for v in affine[:5]], F.lit(affine[5]) + F.col("wobble"))
    same = tiles.same_grid(F.array(*[F.lit(v) for v in affine]), F.lit(512), other, F.lit(512))
    assert [(round(r[0], 9), r[1]) for r in df.select(tiles.footprint_coverage(moved, ref), same).collect()] == [(1.0, True), (0.95, True), (0.0, False)]
    flat = tuple(F.lit(v) for v in (0.0, 0.0, 0.0, 10.0))
    assert df.select(tiles.footprint_coverage(ref, flat)).first()[0] == 0.0


def test_tile_contract(spark):
    schema = "tile_id string, label int, radar_valid boolean, optical_valid boolean, eligible boolean, b3 double, b8 double, b11 double"
    good = spark.createDataFrame([("t", 1, True, True, True, 0.1, 0.1, 0.1), ("t", None, True, True, False, 0.1, 0.1, 0.1)], schema)
    assert tiles.require_tiles(tiles.tile_quality(good, ["tile_id"])).first()["eligible_pixels"] == 1
    seen = tiles.observation(good)
    assert [(r["label"], r["eligible"]) for r in seen.collect()] == [(-1, True), (-1, True)]
    bad = good.union(spark.createDataFrame([("t", None, True, False, True, 0.1, 0.1, 0.1)], schema))
    with pytest.raises(ContractError, match="masks agree"):
        tiles.require_tiles(tiles.tile_quality(bad, ["tile_id"]))


def test_snap_states_of_the_study_box(spark):
    nodes = spark.createDataFrame([(7, 1.0, 0.0), (3, -1.0, 0.0)], "node_id long, x_m double, y_m double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0), (3, 500.0, 0.0)], "point_id long, x_m double, y_m double")
    got = {r["point_id"]: tuple(r)[1:] for r in spatial.snap(points, nodes, limit_m=5.0, box=(-100.0, -100.0, 100.0, 100.0)).collect()}
    assert got == {1: ("snapped", 3, 1.0, 100.0), 2: ("beyond_snap_limit", None, 89.0, 10.0), 3: ("outside_study_bbox", None, 499.0, 0.0)}
    with pytest.raises(ContractError):
        spatial.snap(points.union(spark.createDataFrame([(4, None, 0.0)], points.schema)), nodes, limit_m=5.0)
    with pytest.raises(ValueError):
        spatial.snap(points, nodes.limit(0), limit_m=5.0)


def test_clip_states_and_pointer(spark):
    rows = [("in", 0.0, 5.0, 10.0, 5.0, 10.0), ("half", 5.0, 6.0, 25.0, 6.0, 20.0), ("out", 50.0, 50.0, 60.0, 50.0, 10.0), ("dot", 1.0, 1.0, 1.0, 1.0, 0.0)]
    lines = spark.createDataFrame(rows, "segment_id string, ax double, ay double, bx double, by_ double, length_m double")
    got = {r["segment_id"]: (r["status"], round(r["within_m"], 6)) for r in spatial.clip_audit(lines, (0.0, 0.0, 15.0, 15.0)).collect()}
    assert got == {"in": ("kept", 10.0), "half": ("kept", 10.0), "out": ("outside_box", 0.0), "dot": ("no_length", 0.0)}
    assert tuple(spatial.nearest_link(lines, 7.0, 5.5, limit=9.0).first()) == ("half", 0.5)
    assert spatial.nearest_link(lines, 900.0, 900.0, limit=9.0).count() == 0


def test_picks_and_keys(spark):
    segments = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d", False)], "segment_id string, bridge boolean")
    seen = spark.createDataFrame([("a",), ("b",), ("d",)], "segment_id string")
    water = spark.createDataFrame([("a", "w", 20.0), ("b", "w", 16.0), ("d", "w", 3.0), ("d", "x", 99.0)], "segment_id string, scenario_id string, supported_water_m double")
    assert tuple(access.inspection(segments, seen, water, "w").first()) == ("a", "b", "c")
    assert tuple(access.inspection(segments, seen, water, "none").first()) == (None, None, "c")
    offered, listed = spark.createDataFrame([("k",), ("m",)], "key string"), spark.createDataFrame([("k",), ("k",), ("z",)], "key string")
    assert {tuple(r) for r in catalog.key_audit(offered, listed, "key").collect()} == {("k", True, 2), ("m", True, 0), ("z", False, 1)}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_places_by_ranges(spark, n):
    rows = spark.range(n).select("id", F.when(F.col("id") % 10 != 0, F.col("id") * 7919 % 101).alias("cost")).repartition(3)
    got = order.placed(rows, F.col("cost").asc_nulls_last(), F.col("id").asc()).collect()
    want = sorted(got, key=lambda r: (r["cost"] is None, r["cost"] or 0, r["id"]))
    assert [r["place"] for r in want] == list(range(1, n + 1))
