"""Contracts of canonical tiles: grids, footprints, masks, and observations without labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.contracts import require

LEAST_FOOTPRINT = 0.98


def same_grid(transform: Column, size: Column, other_transform: Column, other_size: Column, tolerance: float = 1e-10) -> Column:
    """Equal width and height, and all six affine numbers within ``tolerance``."""
    near = F.forall(F.arrays_zip(transform.alias("a"), other_transform.alias("b")), lambda e: F.abs(e["a"] - e["b"]) <= tolerance)
    return (size == other_size) & near


def footprint_coverage(source: tuple[Column, Column, Column, Column], reference: tuple[Column, Column, Column, Column]) -> Column:
    """Share of the reference box that the source box covers; 0 for a reference without area."""
    (left, bottom, right, top), (x0, y0, x1, y1) = source, reference
    width = F.greatest(F.lit(0.0), F.least(right, x1) - F.greatest(left, x0))
    height = F.greatest(F.lit(0.0), F.least(top, y1) - F.greatest(bottom, y0))
    area = (x1 - x0) * (y1 - y0)
    return F.when(area > 0, width * height / area).otherwise(0.0)


def tile_quality(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Quality row of each tile; ``broken_masks`` counts eligible pixels that lack a label or a sensor."""
    both = F.col("radar_valid") & F.col("optical_valid")
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("pixels"),
        F.count_if("radar_valid").alias("radar_valid_pixels"),
        F.count_if("optical_valid").alias("optical_valid_pixels"),
        F.count_if(both).alias("paired_valid_pixels"),
        F.count("label").alias("labelled_pixels"),
        F.count_if("eligible").alias("eligible_pixels"),
        F.count_if(F.col("eligible") & ~(both & F.col("label").isNotNull())).alias("broken_masks"),
    )


def require_tiles(quality: DataFrame) -> DataFrame:
    """``quality`` itself; a tile with broken masks or no eligible pixel raises ``ContractError``."""
    return require(quality, {"masks agree": F.col("broken_masks") == 0, "some pixel is eligible": F.col("eligible_pixels") > 0})


def observation(pixels: DataFrame, near_zero: float = 1e-6) -> DataFrame:
    """Pixels as a case study sees them: no label is read, and support rests on the sensors alone."""
    defined = (F.abs(F.col("b3") + F.col("b8")) > near_zero) & (F.abs(F.col("b3") + F.col("b11")) > near_zero)
    support = F.coalesce(F.col("radar_valid") & F.col("optical_valid") & defined, F.lit(False))
    return pixels.drop("label", "eligible").withColumns({"label": F.lit(-1), "eligible": support})
