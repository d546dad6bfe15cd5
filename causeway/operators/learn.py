"""Threshold search, sampling, and the two logistic fits.

Gradients are sums over rows: each step of :func:`fit_logistic` is one aggregate
of as many numbers as there are weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.contracts import require
from causeway.functions.hashing import hash_u64
from causeway.operators.evaluate import event_macro, metrics


def require_train(rows: DataFrame) -> DataFrame:
    """Refuse rows of any split but train."""
    return require(rows, {"split is train": F.col("split") == "train"})


def threshold_curve(pixels: DataFrame, score: Column, thresholds: list[float], *, event: str = "event_id") -> DataFrame:
    """Event-macro IoU of ``score >= threshold`` for each threshold, in one pass over the pixels.

    A pixel is placed once among the sorted thresholds and counted; only these
    counts, one per event, place and label, meet the thresholds.
    """
    cuts = sorted({float(t) for t in thresholds})
    place = F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= F.col("score")))
    scored = pixels.filter("eligible").select(event, "label", score.alias("score")).filter(F.col("score").isNotNull())
    placed = scored.groupBy(event, place.alias("place"), (F.col("label") == 1).alias("truth")).agg(F.count("*").alias("n"))
    grid = pixels.sparkSession.createDataFrame(list(enumerate(cuts)), "k int, threshold double")
    hit, truth = F.col("place") > F.col("k"), F.col("truth")
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("bigint")
    counts = placed.crossJoin(F.broadcast(grid)).groupBy("threshold", event).agg(
        total(truth & hit).alias("tp"), total(~truth & hit).alias("fp"), total(truth & ~hit).alias("fn"), total(~truth & ~hit).alias("tn")
    )
    return event_macro(metrics(counts), "iou", ["threshold"])


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold with the best macro IoU, the smallest on ties."""
    return curve.agg(F.max_by(F.struct("threshold", "macro_iou"), F.struct(F.col("macro_iou"), (-F.col("threshold")).alias("tie"))).alias("b")).select("b.threshold", "b.macro_iou")


def block_sample(pixels: DataFrame, *, size: int, salt: str = "m5-sample-v1", order: list[str]) -> DataFrame:
    """One eligible pixel of each square block, chosen by the block's hash and not by labels."""
    top, left = F.floor(F.col("px_row") / size) * size, F.floor(F.col("px_col") / size) * size
    keyed = pixels.filter("eligible").withColumns({"top": top.cast("bigint"), "left": left.cast("bigint")})
    own = W.partitionBy("tile_id", "top", "left")
    text = F.concat_ws(":", F.lit(salt), "tile_id", "top", "left")
    ranked = keyed.withColumns({"place": F.row_number().over(own.orderBy(*order)) - 1, "available": F.count("*").over(own), "draw": hash_u64(text)})
    return ranked.filter(F.col("place") == (F.col("draw") % F.col("available"))).drop("place", "draw")


def stratified_sample(pixels: DataFrame, *, most: int, key: Column, order: list[str]) -> DataFrame:
    """At most ``most`` pixels per class and event, first capped per tile, in hash order."""
    rows = pixels.filter("eligible").withColumn("digest", F.sha2(key.cast("string"), 256))
    tiles = rows.groupBy("event_id").agg(F.count_distinct("tile_id").alias("tiles"))
    cap = (F.ceil(F.lit(float(most)) / F.col("tiles")) * 2).cast("bigint")
    rows = rows.join(tiles.withColumn("tile_cap", cap).drop("tiles"), "event_id")
    rows = rows.withColumn("in_tile", F.row_number().over(W.partitionBy("tile_id", "label").orderBy("digest", *order))).filter("in_tile <= tile_cap")
    rows = rows.withColumn("in_event", F.row_number().over(W.partitionBy("event_id", "label").orderBy("digest", *order))).filter(F.col("in_event") <= most)
    return rows.drop("digest", "tile_cap", "in_tile", "in_event")


def fit_logistic(rows: DataFrame, features: list[str], *, label: str = "label", steps: int = 150, rate: float = 0.15, ridge: float = 0.01) -> tuple[list[float], list[float]]:
    """Gradient descent from zero with an unpenalised intercept; weights (intercept last) and loss curve.

    ``rows`` should be a staged or cached table: each step reads it once.
    """
    weights = [0.0] * (len(features) + 1)
    curve = []
    n = rows.count()
    if not n:
        return weights, curve
    inputs = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    y = F.col(label).cast("double")
    for _ in range(steps):
        z = F.lit(0.0)
        for x, w in zip(inputs, weights):
            z = z + x * F.lit(w)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        bounded = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
        row = rows.agg(
            *[F.sum((p - y) * x).alias(f"g{k}") for k, x in enumerate(inputs)],
            F.avg(-(y * F.log(bounded) + (1 - y) * F.log(1 - bounded))).alias("loss"),
        ).first()
        curve.append(row["loss"])
        weights = [w - rate * (row[f"g{k}"] / n + (ridge * w if k < len(features) else 0.0)) for k, w in enumerate(weights)]
    return weights, curve


def fit_monotone(samples: DataFrame, *, x: str = "x", y: str = "y", event: str = "event_id", steps: int = 1500, rate: float = 0.25, slope_ridge: float = 0.005) -> dict[str, float]:
    """Event-balanced logistic calibration with a slope kept at or above zero.

    Rows are first summed per event, label and value rounded to 1e-6, which bounds
    what the driver iterates over by the grid of values, not by the rows.
    """
    grid = samples.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(event, F.round(x, 6).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    total = grid.groupBy(event).agg(F.sum("n").alias("event_n"))
    table = grid.join(total, event)
    events = total.count()
    cells = [(r["x"], r["y"], r["n"] / (events * r["event_n"])) for r in table.groupBy("x", "y").agg(F.sum(F.col("n") / F.col("event_n")).alias("w"), F.lit(1).alias("event_n"), F.sum("n").alias("m")).select("x", "y", F.col("w").alias("n"), "event_n").collect()]
    slope, intercept = 2.0, 0.0
    for _ in range(steps if cells else 0):
        ds = di = 0.0
        for value, label, weight in cells:
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * value + intercept)))) - label
            ds += weight * error * value
            di += weight * error
        slope = max(0.0, slope - rate * (ds + slope_ridge * slope))
        intercept -= rate * di
    return {"slope": slope, "intercept": intercept}
