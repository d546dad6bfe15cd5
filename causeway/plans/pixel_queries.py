"""Queries over pixels, labels and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import hashing, pixels as px
from causeway.operators import catalog, compare, evaluate, learn, scenarios
from causeway.plans.bindings import table, view
from causeway.staging import stage

WEIGHTS = [0.4, -0.3, 1.5, 0.5, -2.0, -1.0, -0.5, 1.2, 2.4]
INTERCEPT = 0.1
SLOPE, SHIFT = 2.5, 0.2
GRID = [round(-0.5 + 0.05 * k, 2) for k in range(21)]


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "pixel_v")
    where = F.col("eligible")
    return rows.withColumns({"ndwi": px.normalized_difference(F.col("b3"), F.col("b8"), where), "mndwi": px.normalized_difference(F.col("b3"), F.col("b11"), where)})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir).withColumn("p", px.calibrated(F.col("ndwi"), SLOPE, SHIFT))
    return rows.withColumn("flags", px.quality_flags(F.col("b3"), F.col("b8"), F.col("b11"), F.col("eligible")))


def _r(column, name: str | None = None, digits: int = 6):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name or column)


def split_membership(spark, sf_dir):
    out = catalog.membership(view(spark, sf_dir, "catalog_v"), view(spark, sf_dir, "official_v"), "chip")
    return out.filter("status <> 'agrees'")


def split_mismatch(spark, sf_dir):
    expected = spark.createDataFrame([(f"e{k}",) for k in (0, 1, 2, 3, 7)], "event_id string")
    return catalog.set_mismatch(view(spark, sf_dir, "catalog_v").select("event_id"), expected, "event_id")


def date_offset(spark, sf_dir):
    return view(spark, sf_dir, "catalog_v").select("chip", F.datediff("s2_date", "s1_date").cast("bigint").alias("offset_days"))


def event_id_strings(spark, sf_dir):
    c = F.col("location")
    alias = F.create_map(F.lit("VIETNAM"), F.lit("MEKONG"))
    return view(spark, sf_dir, "catalog_v").select(
        "chip", F.substring_index("chip", "_", 1).alias("prefix"), F.lower(F.replace(c, F.lit(" "), F.lit("-"))).alias("slug"), F.coalesce(F.try_element_at(alias, c), c).alias("event_name")
    )


def bbox_overlap_audit(spark, sf_dir):
    return catalog.overlaps(view(spark, sf_dir, "catalog_v"), "tile_key", cell=6.0).select("a_tile_key", "b_tile_key")


def overlap_split_leakage(spark, sf_dir):
    pairs = catalog.overlaps(view(spark, sf_dir, "catalog_v"), "tile_key", cell=6.0, carry=["split"])
    return catalog.leaks(pairs).groupBy("a_split", "b_split").agg(F.count("*").alias("pairs"))


def bbox_centroids(spark, sf_dir):
    rows = view(spark, sf_dir, "catalog_v")
    return rows.select("chip", _r((F.col("xmin") + F.col("xmax")) / 2, "cx"), _r((F.col("ymin") + F.col("ymax")) / 2, "cy"), ((F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))).alias("sane"))


def split_counts(spark, sf_dir):
    return view(spark, sf_dir, "catalog_v").groupBy("split").agg(F.count("*").alias("tiles"), F.count_distinct("event_id").alias("events"))


def duplicate_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return catalog.duplicates(lines, ["l_orderkey", "l_linenumber"]).groupBy("copies").agg(F.count("*").alias("keys"))


def split_overlap(spark, sf_dir):
    return catalog.split_overlap(_pixels(spark, sf_dir), "px_row", "split")


def hash_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("m5-cal-v1:"), "doc_id").alias("text"))
    return rows.select("doc_id", hashing.bucket(F.col("text"), 97).cast("bigint").alias("bucket"))


def event_hash_rank(spark, sf_dir):
    events = view(spark, sf_dir, "pixel_v").select("event_id").distinct()
    return hashing.ranked(events, F.concat(F.lit("m5-cal-v1:"), "event_id"), tie=["event_id"]).withColumn("hash_rank", F.col("hash_rank").cast("bigint"))


def nested_subset(spark, sf_dir):
    tiles = view(spark, sf_dir, "pixel_v").filter("split = 'train'").select("event_id", "tile_id").distinct()
    key = F.concat_ws(":", F.lit("m4-nested-v1"), "event_id", "tile_id")
    return hashing.first_by_hash(tiles, key, 4, within=["event_id"], tie=["tile_id"]).select("event_id", "tile_id", F.col("hash_rank").cast("bigint").alias("hash_rank"))


def stage_topk(spark, sf_dir):
    tiles = view(spark, sf_dir, "pixel_v").filter("split <> 'final_test'").select("split", "event_id", "tile_id").distinct()
    key = F.concat(F.lit("m3_event_development_v1:"), "tile_id")
    return hashing.first_by_hash(tiles, key, 3, within=["split", "event_id"], tie=["tile_id"]).select("split", "event_id", "tile_id")


def staged_object_keys(spark, sf_dir):
    layers = spark.createDataFrame([("label",), ("radar",), ("optical",)], "layer string")
    return stage_topk(spark, sf_dir).crossJoin(F.broadcast(layers)).select(F.concat_ws("/", "split", "layer", "tile_id").alias("object_key"))


def block_sample(spark, sf_dir):
    out = learn.block_sample(_pixels(spark, sf_dir).filter("split = 'train'"), size=512, order=["px_row", "px_col", "px_tie"])
    return out.select("tile_id", "top", "left", "px_row", "px_col", "px_tie", "available")


def stratified_sample(spark, sf_dir):
    rows = _pixels(spark, sf_dir).filter("split = 'train'")
    key = F.concat_ws(":", F.lit("sample"), "tile_id", "px_row", "px_col", "px_tie")
    return learn.stratified_sample(rows, most=200, key=key, order=["px_row", "px_col", "px_tie"]).select("event_id", "tile_id", "label", "px_row", "px_col", "px_tie")


def ndwi_mndwi(spark, sf_dir):
    return _pixels(spark, sf_dir).select("tile_id", "px_row", "px_col", "px_tie", _r("ndwi"), _r("mndwi"))


def eligible_counts(spark, sf_dir):
    return _pixels(spark, sf_dir).groupBy("event_id").agg(F.count_if("eligible").alias("eligible"), F.count_if(F.col("radar_valid") & F.col("optical_valid")).alias("paired"), F.count("label").alias("labelled"))


def features_clip(spark, sf_dir):
    rows, where = _pixels(spark, sf_dir), F.col("eligible")
    return rows.select(
        "tile_id",
        "px_row",
        "px_col",
        "px_tie",
        *[_r(px.radar_channel(F.col(b), where), f"in_{b}") for b in ("vv", "vh")],
        *[_r(px.optical_channel(F.col(b), where), f"in_{b}") for b in ("b3", "b4", "b8", "b11", "b12")],
    )


def quality_flags(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("event_id", "flags").agg(F.count("*").alias("pixels"))


def quality_strata(spark, sf_dir):
    return evaluate.quality_strata(_scored(spark, sf_dir), ["event_id"])


def retained_state(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    kept = px.retained(F.col("p"), F.col("flags"), F.col("eligible"))
    return rows.withColumn("state", px.state(F.col("p"), kept, F.col("eligible"))).groupBy("event_id", "state").agg(F.count("*").alias("pixels"))


def _counts(spark, sf_dir, keys):
    return evaluate.confusion(_pixels(spark, sf_dir), F.col("mndwi") >= 0.15, keys)


def confusion_by_tile(spark, sf_dir):
    return _counts(spark, sf_dir, ["event_id", "tile_id"])


def metrics_by_event(spark, sf_dir):
    out = evaluate.metrics(evaluate.pooled(_counts(spark, sf_dir, ["event_id", "tile_id"]), ["event_id"]))
    return out.select("event_id", *evaluate.COUNTS, *[_r(c) for c in ("iou", "f1", "precision", "recall")])


def event_macro(spark, sf_dir):
    by_event = evaluate.metrics(_counts(spark, sf_dir, ["event_id"]))
    return evaluate.event_macro(by_event, "iou").select(_r("macro_iou"), "defined_events")


def support_coverage(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    return evaluate.support_coverage(rows, ["event_id"], labelled=F.col("label").isNotNull(), where=F.col("eligible")).withColumn("coverage", F.round("coverage", 6))


def worst_tile(spark, sf_dir):
    return evaluate.worst_rows(_counts(spark, sf_dir, ["event_id", "tile_id"]), ["event_id"], "tile_id")


def sensor_availability(spark, sf_dir):
    return evaluate.sensor_availability(_pixels(spark, sf_dir), ["event_id"])


def threshold_curve(spark, sf_dir):
    rows = _pixels(spark, sf_dir).filter("split = 'train'")
    return learn.threshold_curve(rows, F.col("ndwi"), GRID).select("threshold", _r("macro_iou"), "defined_events")


def best_threshold(spark, sf_dir):
    rows = _pixels(spark, sf_dir).filter("split = 'train'")
    return learn.best_threshold(learn.threshold_curve(rows, F.col("ndwi"), GRID)).select("threshold", _r("macro_iou"))


def logistic_score(spark, sf_dir):
    rows, where = _pixels(spark, sf_dir), F.col("eligible")
    inputs = [px.radar_channel(F.col(b), where) for b in ("vv", "vh")] + [px.optical_channel(F.col(b), where) for b in ("b3", "b4", "b8", "b11", "b12")] + [F.col("ndwi"), F.col("mndwi")]
    score = F.when(where, px.logistic(inputs, WEIGHTS, INTERCEPT))
    return rows.select("tile_id", "px_row", "px_col", "px_tie", _r(score, "score"))


def calibrated_probability(spark, sf_dir):
    return _scored(spark, sf_dir).select("tile_id", "px_row", "px_col", "px_tie", _r("p"), _r(px.unit_scaled(F.col("ndwi")), "unit_ndwi"))


def reliability_bins(spark, sf_dir):
    out = evaluate.reliability_bins(view(spark, sf_dir, "doc_label_v"), ["event_id"])
    return out.select("event_id", F.col("bin").cast("bigint").alias("bin"), "pixels", _r("positives"), _r("sum_p", digits=5), _r("sum_brier", digits=5), _r("sum_log_loss", digits=4))


def _summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = evaluate.reliability_summary(evaluate.reliability_bins(rows, ["event_id"]), keys)
    return out.select(*keys, "pixels", *[_r(c, digits=5) for c in ("prevalence", "brier", "log_loss", "ece")])


def reliability_summary(spark, sf_dir):
    return _summary(_scored(spark, sf_dir).filter("eligible"), ["event_id"])


def reliability_pooled(spark, sf_dir):
    return _summary(_scored(spark, sf_dir).filter("eligible"), [])


def abstention_table(spark, sf_dir):
    out = evaluate.abstention(_scored(spark, sf_dir).filter("eligible"), ["event_id"], [0.0, 0.15, 0.25])
    return out.withColumns({c: F.round(c, 5) for c in ("conditional_error", "retained_brier")})


def calibration_weights(spark, sf_dir):
    rows = view(spark, sf_dir, "doc_label_v").filter("label IS NOT NULL")
    out = evaluate.calibration_weights(rows, "event_id").groupBy("event_id").agg(F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("label")).alias("positive"))
    return out.select("event_id", _r("total"), _r("positive"))


def class_weight(spark, sf_dir):
    rows = _pixels(spark, sf_dir).filter("eligible").groupBy("event_id").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return rows.select("event_id", _r(px.positive_weight(F.col("pos"), F.col("neg")), "positive_weight"))


def stress_block_pixels(spark, sf_dir):
    tiles = _pixels(spark, sf_dir).groupBy("tile_id").agg((F.max("px_row") - F.min("px_row") + 1).alias("height"), F.lit(64).cast("bigint").alias("width"))
    return scenarios.stress_block(tiles).select("tile_id", "side", "top", "left")


def late_fusion(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    radar = F.when(F.col("radar_valid"), px.sigmoid(F.col("vh") / 10.0 + 1.0))
    optical = F.when(F.col("eligible"), px.unit_scaled(F.col("ndwi")))
    fused = px.late_fusion(radar, optical, optical.isNotNull())
    return rows.select("tile_id", "px_row", "px_col", "px_tie", _r(fused, "fused"))


def optical_conditions(spark, sf_dir):
    rows, where = _pixels(spark, sf_dir), F.col("eligible")
    clean = px.optical_channel(F.col("b3"), where)
    names = spark.createDataFrame([("clean",), ("brightened",), ("absent",)], "condition string")
    value = F.when(F.col("condition") == "absent", 0.0).when(F.col("condition") == "brightened", px.brightened(F.col("clean"))).otherwise(F.col("clean"))
    out = rows.withColumn("clean", clean).crossJoin(F.broadcast(names)).groupBy("event_id", "condition").agg(F.avg(value).alias("mean_input"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return out.select("event_id", "condition", *[_r(c, digits=5) for c in ("mean_input", "least", "greatest")])


def _masks(spark, sf_dir):
    return scenarios.masks(_scored(spark, sf_dir), block=512)


def scenario_masks(spark, sf_dir):
    return _masks(spark, sf_dir).groupBy("scenario_id", "value").agg(F.count("*").alias("pixels"))


def scenario_summary(spark, sf_dir):
    return scenarios.summary(_masks(spark, sf_dir), ["event_id"]).withColumn("water_fraction", F.round("water_fraction", 6))


def scenario_jaccard(spark, sf_dir):
    rows = _masks(spark, sf_dir)
    out = scenarios.agreement(rows, ["event_id"], ["tile_id", "px_row", "px_col", "px_tie", "vh", "b8", "b11", "radar_valid", "label"], first="threshold_0.65", last="threshold_0.35")
    return out.select("event_id", _r("jaccard"), _r("unanimous_fraction"))


def band_stats(spark, sf_dir):
    out = evaluate.band_statistics(_pixels(spark, sf_dir), ["event_id"], ["vh", "b3", "b8", "b11"])
    return out.select("event_id", "band", *[_r(c) for c in ("least", "median", "greatest", "zero_fraction")], "missing")


def percentile_stretch(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    limits = rows.groupBy("event_id").agg(F.percentile("b3", F.lit(0.02)).alias("low"), F.percentile("b3", F.lit(0.98)).alias("high"))
    out = rows.join(F.broadcast(limits), "event_id").select("event_id", px.stretched(F.col("b3"), F.col("low"), F.col("high")).alias("s"))
    return out.groupBy("event_id").agg(F.round(F.avg("s"), 5).alias("mean_stretched"), F.count_if(F.col("s") == 1).alias("saturated"))


def _gains(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    seeds = spark.createDataFrame([(0, 0.0), (1, 0.05), (2, -0.05)], "seed int, shift double")
    scored = rows.crossJoin(F.broadcast(seeds))
    model = evaluate.metrics(evaluate.confusion(scored, F.col("mndwi") + F.col("shift") >= 0.15, ["seed", "event_id"])).select("seed", "event_id", "iou")
    reference = evaluate.metrics(evaluate.confusion(rows, F.col("vh") <= -23.0, ["event_id"])).select("event_id", F.col("iou").alias("reference_iou"))
    return model.join(reference, "event_id").withColumn("method", F.lit("mndwi"))


def model_gain_vs_reference(spark, sf_dir):
    return _gains(spark, sf_dir).select(F.col("seed").cast("bigint").alias("seed"), "event_id", _r(F.col("iou") - F.col("reference_iou"), "gain"))


def promotion_rule(spark, sf_dir):
    return evaluate.promotion(_gains(spark, sf_dir)).select("method", _r("least_gain"), _r("worst_loss"), "promoted")


def step_parity(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("steps"))
    out = evaluate.step_parity(runs, ["c_mktsegment"], "steps", 0.5)
    return out.select("c_mktsegment", _r("spread"), "parity")


def replay_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    changed = rows.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 10 == 4, 0).otherwise(F.col("s_nationkey")))
    return compare.replay_diff(rows, changed)


def tolerance_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    other = rows.filter("s_suppkey % 13 <> 1").withColumn("s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") % 7 == 2, 0.5).otherwise(0.0))
    return compare.tolerance_diff(rows, other, ["s_suppkey"], ["s_acctbal"])


def set_checks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return compare.set_relation(lines.filter("l_discount > 0.05").select("l_partkey"), lines.filter("l_tax > 0.02").select("l_partkey"))


def logistic_fit(spark, sf_dir):
    """Weights of the linear model after all steps of gradient descent on the train events."""
    rows, where = _pixels(spark, sf_dir).filter("split = 'train' AND eligible"), F.col("eligible")
    inputs = {b: px.radar_channel(F.col(b), where) for b in ("vv", "vh")} | {b: px.optical_channel(F.col(b), where) for b in ("b3", "b4", "b8", "b11", "b12")} | {b: F.col(b) for b in ("ndwi", "mndwi")}
    table_ = stage(rows.select("label", *[c.alias(f"in_{n}") for n, c in inputs.items()]), "features")
    names = [f"in_{f}" for f in px.FEATURES]
    weights, curve = learn.fit_logistic(table_, names)
    return spark.createDataFrame([*zip([*px.FEATURES, "intercept"], map(float, weights)), ("loss", float(curve[-1]))], "name string, value double")


def monotone_fit(spark, sf_dir):
    """Slope and intercept of the event-balanced calibration of the water index."""
    rows = learn.block_sample(_pixels(spark, sf_dir).filter("split = 'train'"), size=32, order=["px_row", "px_col", "px_tie"])
    fit = learn.fit_monotone(rows.select("event_id", F.col("ndwi").alias("x"), F.col("label").alias("y")))
    return spark.createDataFrame([(k, float(v)) for k, v in fit.items()], "name string, value double")


QUERIES = {
    f.__name__: f
    for f in (
        split_membership, split_mismatch, date_offset, event_id_strings, bbox_overlap_audit, overlap_split_leakage, bbox_centroids, split_counts, duplicate_audit, split_overlap,
        hash_bucket, event_hash_rank, nested_subset, stage_topk, staged_object_keys, block_sample, stratified_sample, ndwi_mndwi, eligible_counts, features_clip, quality_flags, quality_strata,
        retained_state, confusion_by_tile, metrics_by_event, event_macro, support_coverage, worst_tile, sensor_availability, threshold_curve, best_threshold, logistic_score,
        calibrated_probability, reliability_bins, reliability_summary, reliability_pooled, abstention_table, calibration_weights, class_weight, stress_block_pixels, late_fusion,
        optical_conditions, scenario_masks, scenario_summary, scenario_jaccard, band_stats, percentile_stretch, model_gain_vs_reference, promotion_rule, step_parity, replay_diff,
        tolerance_diff, set_checks, logistic_fit, monotone_fit,
    )
}
