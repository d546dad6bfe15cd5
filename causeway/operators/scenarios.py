"""Scenario ensembles over probabilities, and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions.hashing import unit

THRESHOLDS = (0.65, 0.50, 0.35)
SEEDS = tuple(range(501, 509))
BLOCK = 64
OFFSET = 0.12
# Fixed values of the case study: a cut of the water index, variants around it, and shared offsets.
CASE_PRIMARY = "m3_ndwi_reference"
CASE_CUT = -0.05
CASE_VARIANTS = (-0.10, 0.10)
CASE_SEEDS = tuple(range(601, 609))
CASE_OFFSET = 0.08
#: Rows of block offsets up to which they are broadcast (about 60 bytes each).
BROADCAST_SHIFTS = 200_000


def masks(
    scored: DataFrame,
    *,
    probability: str = "p",
    thresholds: tuple[float, ...] = THRESHOLDS,
    seeds: tuple[int, ...] = SEEDS,
    block: int = BLOCK,
    offset: float = OFFSET,
    salt: str = "m5-block-v1",
) -> DataFrame:
    """Long masks ``scenario_id, value``: fixed thresholds, and one hash offset per block and seed.

    Unknown pixels stay NULL in every scenario.
    """
    fixed = _fixed(scored, probability, {f"threshold_{t:.2f}": float(t) for t in thresholds})
    moved = _shifted(scored, probability, {f"offset_seed_{s}": int(s) for s in seeds}, block=block, offset=offset, salt=salt, cut=0.5)
    return fixed.unionByName(moved)


def _fixed(scored: DataFrame, score: str, cuts: dict[str, float]) -> DataFrame:
    """A mask per named cut: ``score >= cut``."""
    table = scored.sparkSession.createDataFrame(list(cuts.items()), "scenario_id string, threshold double")
    known = F.col("eligible") & F.col(score).isNotNull()
    return scored.crossJoin(F.broadcast(table)).withColumn("value", F.when(known, (F.col(score) >= F.col("threshold")).cast("int"))).drop("threshold")


def _shifted(scored: DataFrame, probability: str, seeds: dict[str, int], *, block: int, offset: float, salt: str, cut: float) -> DataFrame:
    """A mask per named seed: the probability, moved by one hash offset per block and clipped, against ``cut``."""
    known = F.col("eligible") & F.col(probability).isNotNull()
    placed = scored.withColumns({f"block_{n}": (F.floor(F.col(c) / block) * block).cast("bigint") for n, c in (("top", "px_row"), ("left", "px_col"))})
    place = ["tile_id", "block_top", "block_left"]
    # The hash is taken once per block and seed, not once per pixel.
    seeds_table = scored.sparkSession.createDataFrame(list(seeds.items()), "scenario_id string, seed int")
    shifts = placed.select(*place).distinct().crossJoin(F.broadcast(seeds_table))
    shifts = shifts.withColumn("shift", (2 * unit(F.concat_ws(":", F.lit(salt), *place, "seed")) - 1) * offset).drop("seed")
    few = shifts.limit(BROADCAST_SHIFTS + 1).count() <= BROADCAST_SHIFTS
    moved = placed.join(F.broadcast(shifts) if few else shifts, place)
    value = F.greatest(F.least(F.col(probability) + F.col("shift"), F.lit(1.0)), F.lit(0.0)) >= cut
    return moved.withColumn("value", F.when(known, value.cast("int"))).drop("shift", *place[1:])


def case_masks(
    scored: DataFrame,
    *,
    slope: float,
    intercept: float,
    probability: str = "p",
    index: str = "ndwi",
    cut: float = CASE_CUT,
    variants: tuple[float, ...] = CASE_VARIANTS,
    seeds: tuple[int, ...] = CASE_SEEDS,
    block: int = BLOCK,
    offset: float = CASE_OFFSET,
) -> DataFrame:
    """All masks of the case study: those of :func:`masks`, a fixed cut of the index, its variants, and shared offsets.

    Members with shared offsets are compared with the calibrated probability of
    the cut, not with one half.
    """
    cuts = {CASE_PRIMARY: cut} | {f"m3_ndwi_threshold_{cut + v:+.2f}": cut + v for v in variants}
    base = 1 / (1 + math.exp(-(slope * cut + intercept)))
    shared = _shifted(scored, probability, {f"m3_shared_offset_seed_{s}": int(s) for s in seeds}, block=block, offset=offset, salt="m6-block-v1", cut=base)
    return masks(scored, probability=probability, block=block).unionByName(_fixed(scored, index, cuts)).unionByName(shared)


def ordered(rows: DataFrame, primary: str = CASE_PRIMARY) -> DataFrame:
    """One row per scenario with its place for display: the primary one, the middle threshold, case members, others, then by name."""
    name = F.col("scenario_id")
    rank = F.when(name == primary, 0).when(name == "threshold_0.50", 1).when(name.startswith("m3_"), 2).otherwise(3)
    return rows.withColumn("place", F.row_number().over(W.orderBy(rank, name)).cast("bigint"))  # as many rows as scenarios


def summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """Water pixels and share of the known ones per scenario."""
    return long.groupBy(*keys, "scenario_id").agg(F.count("value").alias("known_pixels"), F.coalesce(F.sum("value"), F.lit(0)).cast("bigint").alias("water_pixels")).withColumn(
        "water_fraction", F.try_divide(F.col("water_pixels").cast("double"), F.col("known_pixels").cast("double"))
    )


def agreement(long: DataFrame, keys: list[str], pixel: list[str], *, first: str, last: str) -> DataFrame:
    """Jaccard index of two scenarios, and the share of pixels on which all scenarios agree."""
    by_pixel = long.filter(F.col("value").isNotNull()).groupBy(*keys, *pixel).agg(
        F.max(F.when(F.col("scenario_id") == first, F.col("value"))).alias("a"),
        F.max(F.when(F.col("scenario_id") == last, F.col("value"))).alias("b"),
        (F.min("value") == F.max("value")).alias("unanimous"),
    )
    return by_pixel.groupBy(*keys).agg(
        F.try_divide(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).cast("double"), F.count_if((F.col("a") == 1) | (F.col("b") == 1)).cast("double")).alias("jaccard"),
        F.try_divide(F.count_if("unanimous").cast("double"), F.count("*").cast("double")).alias("unanimous_fraction"),
    )


def stress_block(tiles: DataFrame, *, fraction: float = 0.25, salt: str = "m4-stress-v1") -> DataFrame:
    """A square block per tile of ``tiles(tile_id, height, width)``, placed by two words of the tile's hash."""
    from causeway.functions.hashing import hash_u64

    text = F.concat_ws(":", F.lit(salt), "tile_id")
    side = F.bround(F.sqrt(F.lit(float(fraction))) * F.least("height", "width").cast("double"), 0).cast("bigint")
    out = tiles.withColumn("side", side)
    place = lambda word, size: (hash_u64(text, word) % (F.col(size) - F.col("side") + 1)).cast("bigint")
    return out.withColumns({"top": place(0, "height"), "left": place(1, "width")})
