"""Pixels, evaluation, learning and scenarios on hand-made inputs."""

from __future__ import annotations

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.contracts import ContractError
from causeway.functions import geometry, pixels as px
from causeway.operators import catalog, compare, evaluate, learn, scenarios, spatial
from causeway.plans import pixel_queries


@pytest.fixture(scope="module")
def tile(spark):
    rows = [("t", "e", "train", 0, 0, 1, 0.5, 0.1, 0.1, True), ("t", "e", "train", 0, 1, 0, 0.1, 0.5, 0.5, True), ("t", "e", "train", 1, 0, None, 0.0, 0.0, 0.0, False), ("t", "e", "train", 1, 1, 0, 0.1, 0.5, 0.5, True)]
    df = spark.createDataFrame(rows, "tile_id string, event_id string, split string, px_row long, px_col long, label int, b3 double, b8 double, b11 double, eligible boolean")
    return df.withColumn("ndwi", px.normalized_difference(F.col("b3"), F.col("b8"), F.col("eligible")))


def test_unknown_is_never_scored(tile):
    row = evaluate.confusion(tile, F.col("px_col") == 0, ["event_id"]).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["eligible_pixels"]) == (1, 0, 0, 2, 3)
    assert tile.filter("px_row = 1 AND px_col = 0").first()["ndwi"] is None


def test_ratio_without_denominator_is_null(spark):
    counts = spark.createDataFrame([(0, 0, 0, 5, 5)], "tp long, fp long, fn long, tn long, eligible_pixels long")
    assert evaluate.metrics(counts).first()["iou"] is None


def test_smallest_threshold_wins_ties(tile):
    assert learn.best_threshold(learn.threshold_curve(tile, F.col("ndwi"), [-0.5, 0.0, 0.5])).first()["threshold"] == -0.5


def test_split_gate(tile):
    with pytest.raises(ContractError):
        learn.require_train(tile.withColumn("split", F.lit("validation")))


def test_macro_is_the_mean_of_pooled_ratios(spark):
    rows = [("a", 1, 0, 1, 8, 10), ("a", 9, 1, 0, 0, 10), ("b", 1, 1, 8, 0, 10)]
    counts = spark.createDataFrame(rows, "event_id string, tp long, fp long, fn long, tn long, eligible_pixels long")
    by_event = evaluate.metrics(evaluate.pooled(counts, ["event_id"]))
    row = evaluate.event_macro(by_event, "iou").first()
    assert row["macro_iou"] == pytest.approx((10 / 12 + 1 / 10) / 2) and row["defined_events"] == 2


def test_reliability_ignores_unknown(spark):
    df = spark.createDataFrame([("e", 1, 0.8), ("e", None, None), ("e", 0, 0.2), ("e", 1, 0.7)], "event_id string, label int, p double")
    row = evaluate.reliability_summary(evaluate.reliability_bins(df, ["event_id"], bins=5), []).first()
    assert row["pixels"] == 3 and row["brier"] == pytest.approx((0.04 + 0.04 + 0.09) / 3)
    none = evaluate.reliability_summary(evaluate.reliability_bins(df.filter("p > 2"), ["event_id"]), []).first()
    assert none["brier"] is None


def test_late_fusion(spark):
    df = spark.createDataFrame([(0.2, 0.6, True), (0.8, 0.1, False), (0.4, 0.9, True), (None, None, False)], "r double, o double, present boolean")
    got = [r[0] for r in df.select(px.late_fusion(F.col("r"), F.col("o"), F.col("present"))).collect()]
    assert got[:3] == pytest.approx([0.4, 0.8, 0.65]) and got[3] is None


def test_block_sample_does_not_look_at_labels(spark):
    rows = [("t", "e", r, c, int(c >= 16) if not (r < 4 and c < 4) else None) for r in range(32) for c in range(32)]
    df = spark.createDataFrame(rows, "tile_id string, event_id string, px_row long, px_col long, label int").withColumn("eligible", F.col("label").isNotNull())
    place = lambda d: {(r["px_row"], r["px_col"]) for r in learn.block_sample(d, size=8, order=["px_row", "px_col"]).collect()}
    assert place(df) == place(df.withColumn("label", 1 - F.col("label"))) and len(place(df)) == 16


def test_monotone_fit(spark):
    x = [-0.8, -0.6, 0.6, 0.8, -0.7, -0.5, 0.5, 0.7]
    df = spark.createDataFrame([("a" if k < 4 else "b", v, int(v > 0)) for k, v in enumerate(x)], "event_id string, x double, y int")
    fit = learn.fit_monotone(df, steps=300)
    w = np.full(8, 1 / 8)
    s, i = 2.0, 0.0
    for _ in range(300):
        e = w * (1 / (1 + np.exp(-(s * np.array(x) + i))) - (np.array(x) > 0))
        s, i = max(0.0, s - 0.25 * ((e * x).sum() + 0.005 * s)), i - 0.25 * e.sum()
    assert fit["slope"] == pytest.approx(s) and fit["intercept"] == pytest.approx(i)
    assert learn.fit_monotone(df.withColumn("y", 1 - F.col("y")), steps=300)["slope"] == 0.0


def test_logistic_query_takes_all_steps(spark, monkeypatch):
    fit, taken = learn.fit_logistic, []

    def counted(rows, features, **options):
        bound = inspect.signature(fit).bind(rows, features, **options)
        bound.apply_defaults()
        taken.append(bound.arguments["steps"])
        return [0.0] * (len(features) + 1), [0.0]

    monkeypatch.setattr(learn, "fit_logistic", counted)
    pixel_queries.logistic_fit(spark, "/root/testdata/sf0.001")
    assert taken == [150]


def test_logistic_fit_is_gradient_descent(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    y = (x[:, 0] > 0.2).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "f1 double, f2 double, label int").cache()
    weights, curve = learn.fit_logistic(df, ["f1", "f2"], steps=8)
    z = np.concatenate([x, np.ones((40, 1))], axis=1)
    w = np.zeros(3)
    for _ in range(8):
        w = w - 0.15 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) / 40 + 0.01 * np.array([w[0], w[1], 0]))
    assert weights == pytest.approx(w.tolist()) and curve == sorted(curve, reverse=True)


def test_scenarios_nest_and_keep_unknown(spark):
    rows = [("t", r, c, None if r < 2 and c < 2 else (0.55 if r < 8 else 0.8)) for r in range(16) for c in range(16)]
    df = spark.createDataFrame(rows, "tile_id string, px_row long, px_col long, p double").withColumn("eligible", F.col("p").isNotNull())
    long = scenarios.masks(df, seeds=(1, 2), block=8, offset=0.1)
    water = {r["scenario_id"]: (r["known_pixels"], r["water_pixels"]) for r in scenarios.summary(long, []).collect()}
    assert {k for k, _ in water.values()} == {252}
    assert water["threshold_0.65"][1] <= water["threshold_0.50"][1] <= water["threshold_0.35"][1] == 252
    still = scenarios.masks(df, thresholds=(0.5,), seeds=(1,), block=8, offset=0.0)
    assert {r["water_pixels"] for r in scenarios.summary(still, []).collect()} == {252}


def test_stress_block_size(spark):
    row = scenarios.stress_block(spark.createDataFrame([("t", 32, 32)], "tile_id string, height long, width long")).first()
    assert row["side"] == 16 and 0 <= row["top"] <= 16 and 0 <= row["left"] <= 16


def test_touching_boxes_do_not_overlap(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, "train"), (2, 1.0, 0.0, 2.0, 1.0, "train"), (3, 0.5, 0.5, 1.5, 1.5, "final_test")], "k long, xmin double, ymin double, xmax double, ymax double, split string")
    pairs = catalog.overlaps(boxes, "k", cell=1.0, carry=["split"])
    assert {(r["a_k"], r["b_k"]) for r in pairs.collect()} == {(1, 3), (2, 3)}
    assert catalog.leaks(pairs).count() == 2


def test_projection_length(spark):
    x0, y0 = geometry.to_utm(F.lit(-0.76), F.lit(38.1))
    x1, y1 = geometry.to_utm(F.lit(-0.75), F.lit(38.1))
    length = spark.range(1).select(geometry.distance(x0, y0, x1, y1)).first()[0]
    assert 800 < length < 1000
    east, north = spark.range(1).select(*geometry.to_utm(F.lit(-3.0), F.lit(0.0))).first()
    assert east == pytest.approx(500000.0) and north == pytest.approx(0.0, abs=1e-6)


def test_polygon_border_counts(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]])
    df = spark.createDataFrame([(0.0, 2.0), (2.0, 2.0), (5.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(geometry.covers(ring, F.col("x"), F.col("y"))).collect()] == [True, True, False]


def test_resampling(spark):
    grid = spark.createDataFrame([(r, c, float(r + 10 * c)) for r in range(3) for c in range(3)], "px_row long, px_col long, v double")
    targets = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 2.0), (3, 2.5, 0.0)], "target_id long, x double, y double")
    got = {r["target_id"]: r["v"] for r in spatial.resample(grid, targets, value="v").collect()}
    assert got[1] == pytest.approx(5.5) and got[2] == pytest.approx(12.0) and got[3] is None


def test_comparisons(spark):
    a = spark.createDataFrame([(1, 0.1), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 0.1 + 1e-12), (2, None)], "k int, v double")
    assert compare.tolerance_diff(a, b, ["k"], ["v"]).count() == 0
    assert compare.replay_diff(a, a).count() == 0 and compare.replay_diff(a, b).count() == 2


def test_promotion(spark):
    rows = [("m", s, e, i, r) for s, e, i, r in [(0, "a", 0.6, 0.5), (0, "b", 0.5, 0.52), (1, "a", 0.6, 0.5), (1, "b", 0.5, 0.5)]] + [("n", 0, "a", 0.9, 0.5), ("n", 0, "b", 0.3, 0.5)]
    df = spark.createDataFrame(rows, "method string, seed int, event_id string, iou double, reference_iou double")
    assert {r["method"]: r["promoted"] for r in evaluate.promotion(df).collect()} == {"m": True, "n": False}
