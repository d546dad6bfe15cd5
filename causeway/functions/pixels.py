"""Pixel expressions: validity, spectral indices, features, flags and probabilities.

Unknown is NULL throughout and never turns into background.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_ZERO = 1e-6
#: Order of the inputs of the linear model.
FEATURES = ("vv", "vh", "b3", "b4", "b8", "b11", "b12", "ndwi", "mndwi")


def reflectance(digital: Column) -> Column:
    """Top-of-atmosphere reflectance of a scaled integer."""
    return digital.cast("double") / F.lit(10000.0)


def paired(radar_valid: Column, optical_valid: Column) -> Column:
    return radar_valid & optical_valid


def eligible(label: Column, radar_valid: Column, optical_valid: Column, b3: Column, b8: Column, b11: Column) -> Column:
    """A known label, both sensors, and indices whose denominators are not near zero."""
    return F.coalesce(
        label.isNotNull() & paired(radar_valid, optical_valid) & (F.abs(b3 + b8) > NEAR_ZERO) & (F.abs(b3 + b11) > NEAR_ZERO), F.lit(False)
    )


def normalized_difference(a: Column, b: Column, where: Column) -> Column:
    return F.when(where, F.try_divide(a - b, a + b))


def channel(value: Column, shift: float, scale: float, where: Column) -> Column:
    """A centred and scaled input, clipped to 3; 0 where not eligible."""
    return F.when(where, F.greatest(F.least((value + shift) / F.lit(scale), F.lit(3.0)), F.lit(-3.0))).otherwise(F.lit(0.0))


def radar_channel(value: Column, where: Column) -> Column:
    return channel(value, 20.0, 10.0, where)


def optical_channel(value: Column, where: Column) -> Column:
    return channel(value, -0.2, 0.2, where)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def logistic(values: list[Column], weights: list[float], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for value, weight in zip(values, weights):
        total = total + value * F.lit(float(weight))
    return sigmoid(total)


def calibrated(index: Column, slope: float, intercept: float) -> Column:
    clipped = F.greatest(F.least(index, F.lit(1.0)), F.lit(-1.0))
    return F.when(index.isNotNull(), sigmoid(F.lit(float(slope)) * clipped + F.lit(float(intercept))))


def unit_scaled(index: Column) -> Column:
    return F.when(index.isNotNull(), F.greatest(F.least((index + 1.0) / 2.0, F.lit(1.0)), F.lit(0.0)))


def quality_flags(b3: Column, b8: Column, b11: Column, where: Column, *, weak: float = 0.15, bright: float = 0.4) -> Column:
    """1: a weak denominator, 2: a bright band; both add; NULL where unknown."""
    dim = F.least(F.abs(b3 + b8), F.abs(b3 + b11)) < weak
    glare = F.greatest(b3, b8, b11) > bright
    return F.when(where, dim.cast("int") + F.lit(2) * glare.cast("int"))


def retained(probability: Column, flags: Column, where: Column, *, margin: float = 0.15, gated: bool = True) -> Column:
    """Far enough from one half (strictly), and unflagged when ``gated``."""
    clear = where & probability.isNotNull() & (F.abs(probability - 0.5) > margin)
    return F.coalesce(clear & (flags == 0) if gated else clear, F.lit(False))


def state(probability: Column, kept: Column, where: Column) -> Column:
    """Class of a pixel behind the map colours."""
    wet = probability >= 0.5
    return (
        F.when(~where | probability.isNull(), "unknown")
        .when(kept & wet, "retained_wet")
        .when(kept, "retained_dry")
        .when(wet, "withheld_wet")
        .otherwise("withheld_dry")
    )


def late_fusion(radar: Column, optical: Column, present: Column, radar_weight: float = 0.5) -> Column:
    """Weighted mean of two scores, the radar score alone where optics are absent."""
    mean = F.lit(radar_weight) * radar + F.lit(1 - radar_weight) * optical
    return F.when(radar.isNull(), None).when(F.coalesce(present, F.lit(False)), mean).otherwise(radar)


def brightened(value: Column, mix: float = 0.35) -> Column:
    """Channel under simulated haze."""
    return F.greatest(F.least((1 - mix) * value + 2 * mix, F.lit(3.0)), F.lit(-3.0))


#: Conditions under which optical inputs are stressed.
CONDITIONS = ("clean", "missing_optical", "block_missing", "block_brightened")


def observed_optics(value: Column, condition: str, inside: Column, mix: float = 0.35) -> tuple[Column, Column]:
    """Optical input and whether it is present; ``inside`` tells pixels of the stressed block.  Absent inputs are 0."""
    if condition not in CONDITIONS:
        raise ValueError(f"unknown optical condition {condition!r}")
    if condition == "missing_optical":
        return F.lit(0.0), F.lit(False)
    if condition == "block_missing":
        return F.when(inside, 0.0).otherwise(value), ~inside
    if condition == "block_brightened":
        return F.when(inside, brightened(value, mix)).otherwise(value), F.lit(True)
    return value, F.lit(True)


def iso_date(text: Column) -> Column:
    """A date written ``yyyy/MM/dd`` as ISO text; anything else raises."""
    return F.date_format(F.to_date(text, "yyyy/MM/dd"), "yyyy-MM-dd")


def positive_weight(positives: Column, negatives: Column) -> Column:
    return F.least(F.lit(10.0), F.try_divide(negatives.cast("double"), positives.cast("double")))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """Clip into a percentile range and scale to 0 to 1; a constant band is 0."""
    return F.when(high > low, F.greatest(F.least((value - low) / (high - low), F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))
