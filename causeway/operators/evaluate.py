"""Binary detectors: confusion counts, ratios, calibration and abstention.

Counts are pooled before ratios; a ratio without a denominator is NULL; the
macro mean is the mean of per-event ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn", "eligible_pixels")
CLIP = 1e-6


def confusion(pixels: DataFrame, predicted: Column, keys: list[str], *, label: str = "label", where: str = "eligible") -> DataFrame:
    """Confusion counts of eligible pixels per key."""
    truth, hit = F.col(label) == 1, F.col(where)
    return pixels.groupBy(*keys).agg(
        F.count_if(hit & truth & predicted).alias("tp"),
        F.count_if(hit & ~truth & predicted).alias("fp"),
        F.count_if(hit & truth & ~predicted).alias("fn"),
        F.count_if(hit & ~truth & ~predicted).alias("tn"),
        F.count_if(hit).alias("eligible_pixels"),
    )


def pooled(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of confusion counts."""
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def metrics(counts: DataFrame) -> DataFrame:
    """Add iou, f1, precision and recall."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.withColumns(
        {
            "iou": F.try_divide(tp, tp + fp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
        }
    )


def event_macro(by_event: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of the defined per-event values, and how many are defined."""
    return by_event.groupBy(*(keys or [])).agg(F.avg(value).alias(f"macro_{value}"), F.count(value).alias("defined_events"))


def support_coverage(pixels: DataFrame, keys: list[str], *, labelled: Column, where: Column) -> DataFrame:
    """Eligible share of labelled pixels."""
    out = pixels.groupBy(*keys).agg(F.count_if(labelled).alias("labelled_pixels"), F.count_if(labelled & where).alias("eligible_pixels"))
    return out.withColumn("coverage", F.try_divide(F.col("eligible_pixels").cast("double"), F.col("labelled_pixels").cast("double")))


def reliability_bins(scored: DataFrame, keys: list[str], *, label: str = "label", probability: str = "p", bins: int = 10) -> DataFrame:
    """Counts and sums per equal-width probability bin; the last bin holds 1."""
    known = scored.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
    place = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    y, p = F.col(label).cast("double"), F.col(probability)
    clipped = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return known.groupBy(*keys, place.alias("bin")).agg(
        F.count("*").alias("pixels"),
        F.sum(y).alias("positives"),
        F.sum(p).alias("sum_p"),
        F.sum((p - y) * (p - y)).alias("sum_brier"),
        F.sum(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("sum_log_loss"),
    )


def reliability_summary(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Prevalence, Brier score, log loss and expected calibration error from bins, pooled over what is not a key."""
    pooled_bins = bins.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("pixels", "positives", "sum_p", "sum_brier", "sum_log_loss")])
    n = F.sum("pixels")
    return pooled_bins.groupBy(*keys).agg(
        n.alias("pixels"),
        F.try_divide(F.sum("positives"), n).alias("prevalence"),
        F.try_divide(F.sum("sum_brier"), n).alias("brier"),
        F.try_divide(F.sum("sum_log_loss"), n).alias("log_loss"),
        F.try_divide(F.sum(F.abs(F.col("sum_p") - F.col("positives"))), n).alias("ece"),
    )


def abstention(scored: DataFrame, keys: list[str], margins: list[float], *, label: str = "label", probability: str = "p", flags: str = "flags") -> DataFrame:
    """Retention under each margin, with and without the quality gate."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(float(m), g) for m in margins for g in (False, True)], "margin double, gated boolean")
    known = scored.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
    p, y = F.col(probability), F.col(label)
    keep = (F.abs(p - 0.5) > F.col("margin")) & (~F.col("gated") | (F.col(flags) == 0))
    wrong = (p >= 0.5) != (y == 1)
    error = (p - y.cast("double")) * (p - y.cast("double"))
    out = known.crossJoin(F.broadcast(grid)).groupBy(*keys, "margin", "gated").agg(
        F.count("*").alias("pixels"),
        F.count_if(keep).alias("retained_pixels"),
        F.count_if(keep & wrong).alias("retained_errors"),
        F.count_if(~keep & (y == 1)).alias("withheld_water"),
        F.sum(F.when(keep, error)).alias("sum_brier"),
    )
    kept = F.col("retained_pixels").cast("double")
    return out.withColumns({"conditional_error": F.try_divide(F.col("retained_errors").cast("double"), kept), "retained_brier": F.try_divide(F.col("sum_brier"), kept)}).drop("sum_brier")


def quality_strata(scored: DataFrame, keys: list[str], *, flags: str = "flags") -> DataFrame:
    """Pixels that are ordinary, weak in a denominator, and bright."""
    f = F.col(flags)
    return scored.groupBy(*keys).agg(
        F.count_if(f == 0).alias("ordinary_pixels"), F.count_if(f.bitwiseAND(F.lit(1)) == 1).alias("weak_pixels"), F.count_if(f.bitwiseAND(F.lit(2)) == 2).alias("bright_pixels")
    )


def sensor_availability(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled pixels with radar, optics, both, and a common eligible support."""
    known = F.col("label").isNotNull()
    return pixels.groupBy(*keys).agg(
        F.count_if(known).alias("labelled"),
        F.count_if(known & F.col("radar_valid")).alias("labelled_radar"),
        F.count_if(known & F.col("optical_valid")).alias("labelled_optical"),
        F.count_if(known & F.col("radar_valid") & F.col("optical_valid")).alias("labelled_paired"),
        F.count_if(F.col("eligible")).alias("labelled_common"),
    )


def calibration_weights(samples: DataFrame, event: str) -> DataFrame:
    """Weight of each sample so that every event counts equally: 1 / (events * samples of its event)."""
    sizes = samples.groupBy(event).agg(F.count("*").alias("event_samples"))
    events = sizes.agg(F.count("*").alias("events"))
    table = sizes.crossJoin(F.broadcast(events))
    return samples.join(F.broadcast(table) if table.count() <= 100_000 else table, event).withColumn("weight", 1 / (F.col("events").cast("double") * F.col("event_samples")))


def band_statistics(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Per band: least, median and greatest value, share of zeros, and missing values."""
    long = pixels.select(*keys, F.explode(F.create_map(*[x for b in bands for x in (F.lit(b), F.col(b).cast("double"))])).alias("band", "value"))
    return long.groupBy(*keys, "band").agg(
        F.min("value").alias("least"),
        F.percentile("value", F.lit(0.5)).alias("median"),
        F.max("value").alias("greatest"),
        (F.count_if(F.col("value") == 0).cast("double") / F.count("*")).alias("zero_fraction"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    )


def promotion(results: DataFrame, *, gain: float = 0.02, loss: float = 0.05) -> DataFrame:
    """Per method: whether every seed gains enough and loses little on any event.

    ``results(method, seed, event_id, iou, reference_iou)``.
    """
    by_seed = results.groupBy("method", "seed").agg(
        (F.avg("iou") - F.avg("reference_iou")).alias("macro_gain"), F.max(F.col("reference_iou") - F.col("iou")).alias("worst_loss")
    )
    return by_seed.groupBy("method").agg(
        F.min("macro_gain").alias("least_gain"), F.max("worst_loss").alias("worst_loss"), F.bool_and((F.col("macro_gain") >= gain) & (F.col("worst_loss") <= loss)).alias("promoted")
    )


def step_parity(runs: DataFrame, keys: list[str], steps: str, tolerance: float = 0.02) -> DataFrame:
    """Whether the training steps of the runs of a group differ by at most ``tolerance`` of the most."""
    spread = F.try_divide((F.max(steps) - F.min(steps)).cast("double"), F.max(steps).cast("double"))
    return runs.groupBy(*keys).agg(spread.alias("spread")).withColumn("parity", F.col("spread") <= tolerance)


def worst_rows(counts: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The row with most errors of each key; the greatest name on ties."""
    return counts.groupBy(*keys).agg(F.max(F.struct((F.col("fp") + F.col("fn")).alias("errors"), F.col(row).alias("row"))).alias("w")).select(
        *keys, F.col("w.row").alias(row), F.col("w.errors").alias("errors")
    )


def method_counts(pixels: DataFrame, methods: dict[str, tuple[Column, float]], keys: list[str]) -> DataFrame:
    """Confusion counts of several methods, each a score and its threshold, in one pass over the eligible pixels.

    Pixels without a score count as ``undefined`` and in no other column.
    """
    truth, cells = F.col("label") == 1, ("tp", "fp", "fn", "tn", "undefined")
    sums = []
    for k, (score, cut) in enumerate(methods.values()):
        hit = score >= F.lit(float(cut))
        for name, where in zip(cells, (truth & hit, ~truth & hit, truth & ~hit, ~truth & ~hit, score.isNull())):
            sums.append(F.count_if(where).alias(f"{name}_{k}"))
    wide = pixels.filter("eligible").groupBy(*keys).agg(*sums)
    rows = F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{c}_{k}").alias(c) for c in cells]) for k, m in enumerate(methods)])
    return wide.select(*keys, F.explode(rows).alias("row")).select(*keys, "row.*")


def retention(scored: DataFrame, keys: list[str], kept: Column) -> DataFrame:
    """Tiles, eligible and water pixels of each key, and what stays after pixels not ``kept`` are withheld."""
    water = F.col("label") == 1
    out = scored.filter("eligible").groupBy(*keys).agg(
        F.count_distinct("tile_id").alias("tiles"),
        F.count("*").alias("eligible_pixels"),
        F.count_if(water).alias("water_pixels"),
        F.count_if(kept).alias("retained_pixels"),
        F.count_if(water & ~kept).alias("withheld_water"),
    )
    whole = F.col("eligible_pixels").cast("double")
    return out.withColumns({"water_prevalence": F.try_divide(F.col("water_pixels").cast("double"), whole), "retained_fraction": F.try_divide(F.col("retained_pixels").cast("double"), whole)})
