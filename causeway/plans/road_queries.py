"""Queries over road tags, graphs, evidence, closures and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.geometry import covers, distance, to_utm
from causeway.operators import access, graph, order, spatial
from causeway.plans import bundle, lineage
from causeway.plans.bindings import SCENARIOS, evidence, known, table, view, ways
from causeway.staging import new_path, remove, stage, write

BOX = (200.0, 200.0, 700.0, 650.0)
PIXEL_M = 25.0
STEP_M = 15.0


def _r(column, name: str | None = None, digits: int = 6):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name or column)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.segments(ways(spark, sf_dir, marked=True), view(spark, sf_dir, "node_v"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(ways(spark, sf_dir), view(spark, sf_dir, "node_v"))


def _solved(spark: SparkSession, sf_dir: str, scenarios: list[str] | None = None) -> dict[str, DataFrame]:
    """Grid, solutions by key and access rows of the access study; what only the solution needs is removed."""
    grid = access.policy_grid(spark, scenarios or list(SCENARIOS))
    names = sorted([*[r[0] for r in grid.select("scenario_key").collect()], "baseline"])
    nodes, listed, placed = view(spark, sf_dir, "node_v"), new_path(spark, "ways"), new_path(spark, "known")
    write(ways(spark, sf_dir, marked=True), listed, tidy=True)
    read = spark.read.parquet(listed)
    graph.check_places(read, nodes)
    shut = access.shut_words(known(graph.segments(read, nodes)), grid, names)
    write(shut.select("segment_id", "a", "b", "direction", "cost_seconds", "shut"), placed, tidy=True)
    remove(spark, listed)
    edges = graph.directed(spark.read.parquet(placed))
    if edges.isEmpty():
        raise ValueError("the graph has no edge")
    reached, facilities = graph.reach(edges, view(spark, sf_dir, "facility_v"), names, strict=False)
    remove(spark, placed)
    rows = access.access_rows_of_nodes(view(spark, sf_dir, "origin_v"), names, reached, graph.few(facilities))
    return {"grid": grid, "solved": graph.by_key(reached, facilities, names), "rows": rows}


def road_class_filter(spark, sf_dir):
    return graph.rejections(ways(spark, sf_dir))


def road_speed(spark, sf_dir):
    return graph.judged_ways(ways(spark, sf_dir)).filter("reject_reason IS NULL").select("way_id", _r("way_speed.kmh", "kmh"), F.col("way_speed.source").alias("source"))


def travel_direction(spark, sf_dir):
    return graph.judged_ways(ways(spark, sf_dir)).select("way_id", F.col("way_direction.direction").cast("bigint").alias("direction"), F.col("way_direction.source").alias("source"))


def layer_parse(spark, sf_dir):
    return graph.judged_ways(ways(spark, sf_dir)).select("way_id", "bridge", "tunnel", F.col("layer").cast("bigint").alias("layer"))


def way_segments(spark, sf_dir):
    return graph.steps(ways(spark, sf_dir)).select("way_id", F.col("idx").cast("bigint").alias("idx"), "a", "b")


def directed_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("edge_id", "segment_id", "source", "target", _r("cost_seconds"))


def edge_costs(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("highway", "speed_source").agg(F.count("*").alias("edges"), F.round(F.sum("length_m"), 3).alias("length_m"), F.round(F.sum("cost_seconds"), 3).alias("cost_seconds"))


def graph_quality(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    parts = graph.weak_components(edges).groupBy("component").agg(F.count("*").alias("size"))
    whole = parts.agg(F.count("*").alias("weak_components"), F.max("size").alias("largest_component"), F.sum("size").alias("graph_nodes"))
    return whole.crossJoin(edges.agg(F.count("*").alias("directed_edges"), F.count_distinct("segment_id").alias("physical_segments"), F.round(F.sum("length_m"), 3).alias("total_length_m")))


def weak_components(spark, sf_dir):
    return graph.weak_components(_edges(spark, sf_dir))


def nearest_facility(spark, sf_dir):
    out = graph.nearest_facility(_edges(spark, sf_dir), view(spark, sf_dir, "facility_v"), strict=False)
    return out.select("node", _r("cost_seconds"), "facility_id")


def path_audit(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    solved = stage(graph.nearest_facility(edges, view(spark, sf_dir, "facility_v"), strict=False), "solved")
    hops = stage(graph.next_edges(solved, edges).filter("edge_id IS NOT NULL"), "hops")
    ends = view(spark, sf_dir, "facility_v").select("node")
    hops = hops.join(ends, "node", "left_anti").select("node", "target")
    starts = view(spark, sf_dir, "origin_v").join(solved.select("node"), "node")
    return graph.path_audit(starts, hops, view(spark, sf_dir, "node_v")).select("origin_id", "end_node", "hops", _r("border_m"))


def closure_ids(spark, sf_dir):
    return access.judged(known(_segments(spark, sf_dir)), access.policy_grid(spark, list(SCENARIOS))).select("scenario_key", "segment_id", "reason")


def closure_reasons(spark, sf_dir):
    return closure_ids(spark, sf_dir).groupBy("scenario_key", "reason").agg(F.count("*").alias("segments"))


def policy_grid(spark, sf_dir):
    grid = access.policy_grid(spark, list(SCENARIOS))
    origins = view(spark, sf_dir, "origin_v").agg(F.count("*").alias("origins"))
    return grid.crossJoin(origins)


def batched_scenario_cost(spark, sf_dir):
    solved = _solved(spark, sf_dir)["solved"]
    return solved.groupBy("scenario_key").agg(F.count("*").alias("reached_nodes"), F.round(F.sum("cost_seconds"), 3).alias("total_cost_seconds"))


def access_rows(spark, sf_dir):
    rows = _solved(spark, sf_dir)["rows"]
    return rows.select("scenario_key", "origin_id", "nearest_facility_id", _r("estimated_cost_seconds"), _r("baseline_cost_seconds"), _r("cost_delta_seconds"), "baseline_unreachable", "newly_disconnected", "reason")


def access_summary_by_policy(spark, sf_dir):
    """Flagship: from ways and evidence to newly disconnected origins under every assumption."""
    found = _solved(spark, sf_dir)
    summary = access.summarise(found["rows"], ["scenario_key"])
    out = found["grid"].join(summary, "scenario_key")
    return out.select(
        "scenario_id", "policy", "bridge_rule", "origins", "baseline_unreachable", "newly_disconnected", "paired_reachable", _r("mean_increase_seconds", digits=5), _r("greatest_increase_seconds"), "improved"
    )


def ranking_reversals(spark, sf_dir):
    rows = _solved(spark, sf_dir)["rows"]
    return access.ranking_reversals(rows).withColumn("reversal_fraction", F.round("reversal_fraction", 6))


def access_stability(spark, sf_dir):
    rows = _solved(spark, sf_dir)["rows"]
    return access.stability(rows).select("origin_id", "members", "reachable_members", _r("least_cost_seconds"), _r("greatest_cost_seconds"), "newly_disconnected")


def first_disconnected(spark, sf_dir):
    return access.first_disconnected(_solved(spark, sf_dir)["rows"], ["scenario_key"])


def origin_overview(spark, sf_dir):
    found = _solved(spark, sf_dir)
    ranges = stage(access.stability(found["rows"]), "stability")
    out = access.origin_overview(view(spark, sf_dir, "origin_v"), view(spark, sf_dir, "node_v"), found["solved"].filter("scenario_key = 'baseline'"), ranges)
    return out.select("origin_id", "x_m", "y_m", _r("baseline_cost_seconds"), "reachable_members", _r("greatest_cost_seconds"))


def origin_table_sorted(spark, sf_dir):
    rows = _solved(spark, sf_dir)["rows"].filter("scenario_key = 'wet_05|supported_overlap|bridge_exempt'")
    out = order.placed(rows.select("origin_id", "estimated_cost_seconds"), F.col("estimated_cost_seconds").asc_nulls_last(), F.col("origin_id").asc())
    return out.select("origin_id", _r("estimated_cost_seconds"), "place")


def scenario_lookup(spark, sf_dir):
    path = new_path(spark, "bundle")
    own = stage(known(_segments(spark, sf_dir)).select("segment_id", "length_m", "bridge", "tunnel", "seen", "within_tile_m", "retained_m", "water"), "known", tidy=True)
    closed = access.judged(own, access.policy_grid(spark, list(SCENARIOS)))
    closed.write.partitionBy("scenario_id", "policy", "bridge_rule").parquet(f"{path}/closures")
    return bundle.scenario(spark, path, "wet_05", "retained_overlap", "bridge_candidate")


def road_lookup(spark, sf_dir):
    segments = stage(_segments(spark, sf_dir), "segments")
    seen, _ = evidence(spark, sf_dir, segments)
    states = bundle.road_states(segments.select("segment_id", "highway"), seen)
    return states.select("segment_id", "highway", "state", _r("supported_m"), _r("retained_m"))


def export_row(spark, sf_dir):
    closed = closure_ids(spark, sf_dir)
    counts = closed.groupBy("scenario_key").agg(F.count("*").alias("closed")).withColumn("key", F.col("scenario_key"))
    return counts.select("scenario_key", bundle.document(["key", "closed"]))


def bundle_integrity(spark, sf_dir):
    segments = stage(_segments(spark, sf_dir), "segments")
    seen, water = evidence(spark, sf_dir, segments)
    edges = graph.directed(segments)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    missing = lambda a, b, key: a.join(b, key, "left_anti").agg(F.count("*").alias("missing"))
    rows = [
        missing(seen, segments, "segment_id").select(F.lit("evidence_in_roads").alias("rule"), "missing"),
        missing(water, seen, "segment_id").select(F.lit("water_in_evidence").alias("rule"), "missing"),
        missing(view(spark, sf_dir, "facility_v"), nodes, "node").select(F.lit("facility_in_graph").alias("rule"), "missing"),
        missing(view(spark, sf_dir, "origin_v"), nodes, "node").select(F.lit("origin_in_graph").alias("rule"), "missing"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def snap_points(spark, sf_dir):
    out = spatial.snap(view(spark, sf_dir, "point_v"), view(spark, sf_dir, "node_v"), limit_m=12.0, box=(50.0, 50.0, 950.0, 950.0))
    return out.select("point_id", "status", "nearest_node_id", _r("nearest_distance_m"), _r("boundary_distance_m"))


def hospital_radius(spark, sf_dir):
    points = view(spark, sf_dir, "point_v")
    return spatial.within_radius(points, 500.0, 500.0, 250.0).select("point_id", _r(distance(F.col("x_m"), F.col("y_m"), F.lit(500.0), F.lit(500.0)), "distance_m"))


def segment_clip(spark, sf_dir):
    return spatial.clipped(_segments(spark, sf_dir), BOX).select("segment_id", _r("t0"), _r("t1"), _r("within_m"))


def line_samples(spark, sf_dir):
    parts = spatial.clipped(_segments(spark, sf_dir), BOX)
    out = spatial.line_samples(parts, step_m=STEP_M, pixel_m=PIXEL_M).groupBy("segment_id").agg(F.count("*").alias("samples"), F.sum("weight").alias("weight"))
    return out.select("segment_id", "samples", _r("weight", digits=5))


def _evidence_pixels(spark, sf_dir):
    pixels = view(spark, sf_dir, "surface_v")
    return pixels.withColumns({"kept": F.abs(F.col("p") - 0.5) > 0.15, "wet": F.col("p") >= 0.5})


def _streets(spark, sf_dir):
    """Segments with short lines, on a plane that grows with the ways: a way has its own strip."""
    along = lambda node: F.col("way_id") * 8.0 + F.col(node) * 7919 % 97
    across = lambda node: (F.col(node) * 104729 % 401).cast("double")
    return _segments(spark, sf_dir).withColumns({"ax": along("a"), "ay": across("a"), "bx": along("b"), "by_": across("b")})


def road_evidence(spark, sf_dir):
    parts = spatial.clipped(_segments(spark, sf_dir), BOX)
    out = spatial.road_evidence(parts, _evidence_pixels(spark, sf_dir), step_m=STEP_M, pixel_m=PIXEL_M)
    names = ("length_m", "within_tile_m", "supported_m", "retained_m", "flagged_m", "water_m", "unknown_m", "coverage", "mean_score")
    return out.select("segment_id", *[_r(F.col(c) + 1e-9, c, digits=5) for c in names])  # shares of samples often lie between two rounded values


def length_contract(spark, sf_dir):
    parts = spatial.clipped(_segments(spark, sf_dir), BOX)
    out = spatial.road_evidence(parts, _evidence_pixels(spark, sf_dir), step_m=STEP_M, pixel_m=PIXEL_M)
    return out.agg(F.count("*").alias("segments")).crossJoin(access.length_contract(out).agg(F.count("*").alias("broken")))


def crossing_audit(spark, sf_dir):
    out = spatial.crossings(_streets(spark, sf_dir), cell=150.0)
    return out.agg(F.count("*").alias("crossings"), F.count_if("grade_tagged").alias("grade_tagged"), F.count_if(~F.col("grade_tagged")).alias("untagged"))


def crossing_examples(spark, sf_dir):
    """The first ten crossings; the limit is the feature."""
    return spatial.crossings(_streets(spark, sf_dir), cell=150.0).orderBy("left_id", "right_id").limit(10)


def polygon_cover(spark, sf_dir):
    corners = [(100.0, 100.0), (800.0, 200.0), (600.0, 900.0), (400.0, 500.0), (100.0, 100.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return view(spark, sf_dir, "node_v").filter(covers(ring, F.col("x_m"), F.col("y_m"))).select("node_id")


def utm_projection(spark, sf_dir):
    points = view(spark, sf_dir, "node_v").select("node_id", (F.col("x_m") / 1000 - 1.0).alias("lon"), (F.col("y_m") / 1000 + 38.0).alias("lat"))
    x, y = to_utm(F.col("lon"), F.col("lat"))
    return points.select("node_id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


def latest_run(spark, sf_dir):
    hashed = F.sha2(F.col("run_id").cast("string"), 256)
    runs = view(spark, sf_dir, "run_v").withColumns({"manifest_sha256": hashed, "computed_sha256": F.when(F.col("hash_ok"), hashed).otherwise("")})
    return lineage.latest_valid(runs)


def status_ladder(spark, sf_dir):
    return lineage.latest_complete(view(spark, sf_dir, "run_v"), F.col("hash_ok") & (F.col("reference") < 4))


def manifest_files(spark, sf_dir):
    """Expected against found outputs of runs, as their set differences."""
    runs = view(spark, sf_dir, "run_v")
    expected = runs.filter("hash_ok").select(F.concat("milestone", F.lit("/"), "run_id").alias("path"))
    found = runs.filter("status = 'complete'").select(F.concat("milestone", F.lit("/"), "run_id").alias("path"))
    hashed = F.sha2("path", 256).alias("sha256")
    return lineage.verify_outputs(expected.select("path", hashed), found.select("path", hashed)).groupBy("status").agg(F.count("*").alias("files"))


def json_tags(spark, sf_dir):
    rows = view(spark, sf_dir, "tag_v").withColumn("k", F.from_json("props", "k bigint")["k"])
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("k").alias("sum_k"), F.min("k").alias("least_k"))


QUERIES = {
    f.__name__: f
    for f in (
        road_class_filter, road_speed, travel_direction, layer_parse, way_segments, directed_edges, edge_costs, graph_quality, weak_components, nearest_facility, path_audit, closure_ids,
        closure_reasons, policy_grid, batched_scenario_cost, access_rows, access_summary_by_policy, ranking_reversals, access_stability, first_disconnected, origin_overview, origin_table_sorted, scenario_lookup, road_lookup,
        export_row, bundle_integrity, snap_points, hospital_radius, segment_clip, line_samples, road_evidence, length_contract, crossing_audit, crossing_examples, polygon_cover,
        utm_projection, latest_run, status_ladder, manifest_files, json_tags,
    )
}
