"""Queries of the case study, the final evaluation and the contracts of sources and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import pixels as px
from causeway.operators import access, catalog, evaluate, scenarios, spatial, tiles
from causeway.plans import pixel_queries, road_queries, runlog
from causeway.plans.bindings import SCENARIOS, evidence, table, view
from causeway.staging import stage

BUDGETS, SEEDS = (4, 8, 16), (0, 1, 2)
METHODS = ("radar", "optical", "early", "late")


def _r(column, name: str | None = None, digits: int = 6):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name or column)


def _case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water and known pixels of all 22 scenarios."""
    scored = pixel_queries._scored(spark, sf_dir)
    long = scenarios.case_masks(scored, slope=pixel_queries.SLOPE, intercept=pixel_queries.SHIFT, block=512)
    return scenarios.summary(long, []).select("scenario_id", "known_pixels", "water_pixels")


def case_scores(spark, sf_dir):
    """All scenarios of the case study in the order in which they are shown."""
    return scenarios.ordered(_case(spark, sf_dir)).select("place", "scenario_id", "known_pixels", "water_pixels")


def case_grid(spark, sf_dir):
    """The 92 runs of the case study with the water of their scenarios."""
    found = stage(_case(spark, sf_dir), "case")
    return access.case_grid(found, scenarios.CASE_PRIMARY).join(found.select("scenario_id", "water_pixels"), "scenario_id")


def _final(spark, sf_dir):
    return pixel_queries._scored(spark, sf_dir).filter("split = 'final_test'")


def _methods() -> dict:
    """Score and frozen threshold of each method."""
    where = F.col("eligible")
    inputs = [px.radar_channel(F.col(b), where) for b in ("vv", "vh")] + [px.optical_channel(F.col(b), where) for b in ("b3", "b4", "b8", "b11", "b12")] + [F.col("ndwi"), F.col("mndwi")]
    late = px.late_fusion(px.sigmoid(F.col("vh") / 10.0 + 1.0), px.unit_scaled(F.col("ndwi")), where)
    return {
        "radar_vh": (-F.col("vh"), 23.0),
        "ndwi": (F.col("ndwi"), -0.05),
        "mndwi": (F.col("mndwi"), 0.15),
        "logistic": (px.logistic(inputs, pixel_queries.WEIGHTS, pixel_queries.INTERCEPT), 0.5),
        "late": (late, 0.5),
    }


def final_methods(spark, sf_dir):
    out = evaluate.metrics(evaluate.method_counts(_final(spark, sf_dir), _methods(), ["event_id"]))
    return out.select("event_id", "method", "tp", "fp", "fn", "tn", "undefined", _r("iou"), _r("f1"))


def final_macro(spark, sf_dir):
    """Means over events by method, all splits, so that there is more than one event."""
    by_event = evaluate.metrics(evaluate.method_counts(pixel_queries._scored(spark, sf_dir), _methods(), ["event_id"]))
    return by_event.groupBy("method").agg(_r(F.avg("iou"), "macro_iou"), _r(F.avg("f1"), "macro_f1"), F.count("iou").alias("defined_events"))


def final_retention(spark, sf_dir):
    kept = px.retained(F.col("p"), F.col("flags"), F.col("eligible"))
    out = evaluate.retention(_final(spark, sf_dir), ["event_id"], kept)
    return out.withColumns({c: F.round(c, 6) for c in ("water_prevalence", "retained_fraction")})


def chip_event_join(spark, sf_dir):
    chips = view(spark, sf_dir, "catalog_v").select("chip", "location")
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("continent"))
    metadata = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("location"), "continent")
    return catalog.with_metadata(chips, metadata, "location").select("chip", "location", "continent")


def footprint_audit(spark, sf_dir):
    """Sensor boxes, moved a little, against the boxes of their tiles."""
    rows = view(spark, sf_dir, "catalog_v").withColumn("moved", F.col("tile_key") % 5 * 0.05)
    reference = tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    source = (F.col("xmin") + F.col("moved"), F.col("ymin"), F.col("xmax") + F.col("moved"), F.col("ymax"))
    affine = lambda left: F.array(F.lit(0.01), F.lit(0.0), left, F.lit(0.0), F.lit(-0.01), F.col("ymax"))
    share = tiles.footprint_coverage(source, reference)
    size = F.lit(600)
    return rows.select("chip", _r(share, "coverage"), (share >= tiles.LEAST_FOOTPRINT).alias("accepted"), tiles.same_grid(affine(source[0]), size, affine(reference[0]), size).alias("same_grid"))


def tile_quality(spark, sf_dir):
    return tiles.tile_quality(pixel_queries._pixels(spark, sf_dir), ["tile_id"])


def case_observation(spark, sf_dir):
    rows = tiles.observation(view(spark, sf_dir, "pixel_v"))
    return rows.groupBy("event_id").agg(F.count("*").alias("pixels"), F.count_if("eligible").alias("eligible"), F.max("label").cast("bigint").alias("label"))


def inventory_audit(spark, sf_dir):
    """Texts as files: listed sizes against real ones, English ones needed."""
    rows = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("raw/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string")))
    listed = rows.filter("doc_id % 50 <> 7").select("path", F.col("n_chars").cast("bigint").alias("size"))
    found = rows.filter("doc_id % 40 <> 3").select("path", F.when(F.col("doc_id") % 30 == 1, 0).otherwise(F.col("n_chars")).cast("bigint").alias("size"))
    out = catalog.inventory_audit(listed, found, rows.filter("lang = 'en'").select("path"), "raw")
    return out.groupBy("state").agg(F.count("*").alias("paths"))


def fusion_conditions(spark, sf_dir):
    """Inputs, presence and fused score of each event under every optical condition."""
    rows, where = pixel_queries._pixels(spark, sf_dir).filter("eligible"), F.col("eligible")
    sizes = pixel_queries._pixels(spark, sf_dir).groupBy("tile_id").agg(F.min("px_row").alias("row0"), (F.max("px_row") - F.min("px_row") + 1).alias("height"), F.lit(64).cast("bigint").alias("width"))
    placed = rows.join(scenarios.stress_block(sizes), "tile_id")
    inside = (F.col("px_row") - F.col("row0")).between(F.col("top"), F.col("top") + F.col("side") - 1) & (F.col("px_col") - 1).between(F.col("left"), F.col("left") + F.col("side") - 1)
    clean = px.optical_channel(F.col("b3"), where)
    cells = []
    for name in px.CONDITIONS:
        value, present = px.observed_optics(F.col("clean"), name, F.col("inside"))
        cells.append(F.struct(F.lit(name).alias("condition"), value.alias("value"), present.alias("present")))
    long = placed.withColumns({"clean": clean, "inside": inside}).select("event_id", "vh", F.explode(F.array(*cells)).alias("o")).select("event_id", "vh", "o.*")
    fused = px.late_fusion(px.sigmoid(F.col("vh") / 10.0 + 1.0), px.sigmoid(F.col("value")), F.col("present"))
    out = long.groupBy("event_id", "condition").agg(F.count_if("present").alias("present_pixels"), F.avg("value").alias("mean_input"), F.avg(fused).alias("mean_fused"))
    return out.select("event_id", "condition", "present_pixels", _r("mean_input", digits=5), _r("mean_fused", digits=5))


def budget_grid(spark, sf_dir):
    """Planned training runs: every budget, seed, method and condition, with the tiles that each may use."""
    per_event = view(spark, sf_dir, "pixel_v").filter("split = 'train'").groupBy("event_id").agg(F.count_distinct("tile_id").alias("tiles"))
    used = per_event.crossJoin(F.broadcast(spark.createDataFrame([(b,) for b in BUDGETS], "budget bigint"))).groupBy("budget").agg(F.sum(F.least("budget", "tiles")).alias("tiles"))
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "seed bigint")
    methods = spark.createDataFrame([(m,) for m in METHODS], "method string")
    conditions = spark.createDataFrame([(c,) for c in px.CONDITIONS], "condition string")
    return used.crossJoin(F.broadcast(seeds)).crossJoin(F.broadcast(methods)).crossJoin(F.broadcast(conditions))


def normalized_dates(spark, sf_dir):
    written = F.date_format(F.col("o_orderdate").cast("date"), "yyyy/MM/dd")
    return table(spark, sf_dir, "orders").select(px.iso_date(written).alias("day")).groupBy("day").agg(F.count("*").alias("orders"))


def inspection_picks(spark, sf_dir):
    segments = stage(road_queries._segments(spark, sf_dir), "segments")
    seen, water = evidence(spark, sf_dir, segments)
    return access.inspection(segments, seen, water, "wet_05")


def closure_index_audit(spark, sf_dir):
    return catalog.key_audit(access.policy_grid(spark, [*SCENARIOS, "wet_99"]), road_queries.closure_ids(spark, sf_dir), "scenario_key")


def clip_rejects(spark, sf_dir):
    out = spatial.clip_audit(road_queries._segments(spark, sf_dir), road_queries.BOX)
    return out.groupBy("status").agg(F.count("*").alias("segments"), F.round(F.sum("within_m"), 3).alias("within_m"))


def nearest_link(spark, sf_dir):
    out = spatial.nearest_link(road_queries._segments(spark, sf_dir), 512.5, 487.5, limit=9.0, x_scale=0.78)
    return out.select("segment_id", _r("distance"))


def boundary_audit(spark, sf_dir):
    out = access.boundary_summary(road_queries.path_audit(spark, sf_dir), guard_m=50.0)
    return out


def run_gates(spark, sf_dir):
    """Which runs stand, if each rests on the one before it of the same customer."""
    runs = view(spark, sf_dir, "run_v").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey"), "run_id")
    before = F.lag("run_id").over(Window.partitionBy("o_custkey").orderBy("completed_at", "run_id"))
    runs = stage(runs.select("run_id", ((F.col("status") == "complete") & F.col("hash_ok")).alias("sound"), before.alias("rests_on")), "runs")
    return runlog.gates(runs.select("run_id", "sound"), runs.filter("rests_on IS NOT NULL").select("run_id", "rests_on"))


QUERIES = {
    f.__name__: f
    for f in (
        case_scores, case_grid, final_methods, final_macro, final_retention, chip_event_join, footprint_audit, tile_quality, case_observation, inventory_audit, fusion_conditions,
        budget_grid, normalized_dates, inspection_picks, closure_index_audit, clip_rejects, nearest_link, boundary_audit, run_gates,
    )
}
