"""Canonical tiles: sensors on another grid are brought to the grid of the labels by blocks.

Each source pixel is dealt to the blocks of the label grid that its value can reach:
its own and, near a border, the neighbours (the halo).  A block then has all it needs,
so neither a join of all pixels nor a whole tile in one task takes place; one shuffle
of the source pixels does it.

Grids are affine with rows along y and columns along x, without rotation, in one
reference system: ``transform`` maps (column, row) to (x, y) as (a, 0, c, 0, e, f).
Data are bilinear over the valid neighbours (weights scaled to 1 again), validity is
that of the nearest pixel, and data without validity are null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.contracts import ContractError, require
from causeway.functions.pixels import reflectance
from causeway.operators.tiles import LEAST_FOOTPRINT, footprint_coverage

#: Rows and columns of a block of the label grid.
BLOCK = 128
LABELS = (-1, 0, 1)


@dataclass(frozen=True)
class Grid:
    """Size of a raster and its affine transform."""

    width: int
    height: int
    transform: tuple[float, float, float, float, float, float]

    def __post_init__(self) -> None:
        a, b, _, d, e, _ = self.transform
        if self.width <= 0 or self.height <= 0 or b or d or not a or not e:
            raise ContractError("a grid has a size, no rotation and a scale")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, _, c, _, e, f = self.transform
        x, y = (c, c + a * self.width), (f, f + e * self.height)
        return min(x), min(y), max(x), max(y)

    def same(self, other: Grid, tolerance: float = 1e-10) -> bool:
        return (self.width, self.height) == (other.width, other.height) and all(abs(p - q) <= tolerance for p, q in zip(self.transform, other.transform, strict=True))

    def coverage(self, reference: Grid) -> Column:
        """Share of the reference that this grid covers."""
        boxes = [tuple(F.lit(float(v)) for v in g.bounds) for g in (self, reference)]
        return footprint_coverage(*boxes)


def _places(source: Grid, target: Grid) -> tuple[tuple[float, float], tuple[float, float]]:
    """Scale and shift from target rows and columns (centres) to source rows and columns (centres)."""
    a, _, c, _, e, f = source.transform
    ta, _, tc, _, te, tf = target.transform
    return (te / e, (tf + 0.5 * te - f) / e - 0.5), (ta / a, (tc + 0.5 * ta - c) / a - 0.5)


def _blocks(name: str, scale: float, shift: float, size: int, block: int) -> Column:
    """Blocks along one axis that a source place can reach: its value counts less than one source pixel away."""
    ends = [(F.col(name) + d - F.lit(shift)) / F.lit(scale) for d in (-1.0, 1.0)]
    low, high = F.ceil(F.least(*ends) - 1e-9), F.floor(F.greatest(*ends) + 1e-9)
    first, last = F.greatest(low, F.lit(0)), F.least(high, F.lit(size - 1))
    return F.when(first <= last, F.sequence(F.floor(first / block).cast("int"), F.floor(last / block).cast("int"))).otherwise(F.array().cast("array<int>"))


def on_grid(pixels: DataFrame, source: Grid, target: Grid, bands: list[str], *, key: str = "tile_id", block: int = BLOCK) -> DataFrame:
    """``pixels(<key>, px_row, px_col, <bands>)`` of the source grid on the target grid.

    Returns a row per pixel of the target inside every tile that has a source pixel:
    the key, ``px_row``, ``px_col``, the bands and ``valid``.  A null, NaN or infinite
    band or a missing pixel is not valid; ``valid`` asks for all bands.  A source pixel
    given twice raises.
    """
    (row_scale, row_shift), (column_scale, column_shift) = _places(source, target)
    own = pixels.select(F.col(key).alias("tile"), F.col("px_row").cast("bigint").alias("r"), F.col("px_col").cast("bigint").alias("c"), *[F.col(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands)])
    inside = F.col("r").between(0, source.height - 1) & F.col("c").between(0, source.width - 1)
    halo = own.filter(inside).withColumn("block_row", F.explode(_blocks("r", row_scale, row_shift, target.height, block)))
    halo = halo.withColumn("block_col", F.explode(_blocks("c", column_scale, column_shift, target.width, block)))

    def regridded(table: pa.Table) -> pa.Table:
        top, left = table.column("block_row")[0].as_py() * block, table.column("block_col")[0].as_py() * block
        high, wide = min(block, target.height - top), min(block, target.width - left)
        rows, columns = table.column("r").to_numpy(), table.column("c").to_numpy()
        y = (np.arange(top, top + high) * row_scale) + row_shift
        x = (np.arange(left, left + wide) * column_scale) + column_shift
        y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        fy, fx = y - y0, x - x0
        r0, c0 = min(y0.min(), rows.min()), min(x0.min(), columns.min())
        size = (int(max(y0.max() + 1, rows.max()) - r0) + 2, int(max(x0.max() + 1, columns.max()) - c0) + 2)
        at = (rows - r0) * size[1] + columns - c0
        if len(np.unique(at)) < len(at):
            raise ContractError("a source pixel is given twice")
        near_r, near_c = np.floor(y + 0.5).astype(np.int64) - r0, np.floor(x + 0.5).astype(np.int64) - c0
        names, out, valid = ["tile", "px_row", "px_col"], [], np.ones((high, wide), bool)
        for k in range(len(bands)):
            raw = table.column(f"v{k}").to_numpy()
            full = np.full(size, np.nan)
            full[rows - r0, columns - c0] = raw
            known = np.isfinite(full)
            total, weight = np.zeros((high, wide)), np.zeros((high, wide))
            for dr, wr in ((0, 1 - fy), (1, fy)):
                for dc, wc in ((0, 1 - fx), (1, fx)):
                    place = np.ix_(y0 - r0 + dr, x0 - c0 + dc)
                    w = np.outer(wr, wc) * known[place]
                    total += np.where(w > 0, w * np.where(known[place], full[place], 0.0), 0.0)
                    weight += w
            fine = known[np.ix_(near_r, near_c)] & (weight > 0)
            valid &= fine
            out.append(pa.array(np.where(fine, total / np.where(weight > 0, weight, 1.0), 0.0).reshape(-1), mask=~fine.reshape(-1)))
            names.append(f"v{k}")
        grid_r, grid_c = np.meshgrid(np.arange(top, top + high), np.arange(left, left + wide), indexing="ij")
        tile = pa.array([table.column("tile")[0].as_py()] * (high * wide), table.schema.field("tile").type)
        return pa.table([tile, pa.array(grid_r.reshape(-1)), pa.array(grid_c.reshape(-1)), *out, pa.array(valid.reshape(-1))], names=[*names, "valid"])

    kind = own.schema["tile"].dataType.simpleString()
    schema = f"tile {kind}, px_row bigint, px_col bigint, " + ", ".join(f"v{k} double" for k in range(len(bands))) + ", valid boolean"
    done = halo.groupBy("tile", "block_row", "block_col").applyInArrow(regridded, schema)
    return done.select(F.col("tile").alias(key), "px_row", "px_col", *[F.col(f"v{k}").alias(b) for k, b in enumerate(bands)], "valid")


def canonical(labels: DataFrame, radar: DataFrame, optical: DataFrame, grids: dict[str, Grid], *, radar_bands: list[str], optical_bands: list[str], key: str = "tile_id", block: int = BLOCK) -> DataFrame:
    """Pixels of the label grid with both sensors on it, as canonical tiles have them.

    ``labels(<key>, px_row, px_col, label)`` has every pixel of its tiles, with the codes
    -1 (unknown), 0 and 1; any other code raises, and so does a sensor that covers less
    than ``LEAST_FOOTPRINT`` of the label grid.  ``grids`` has those of ``label``,
    ``radar`` and ``optical``.  Radar stays in decibels, optics become reflectance.  A
    sensor on the label grid itself is taken as it is.  The three meet by pixel in one
    aggregation, already dealt by block where a sensor was regridded.
    """
    target = grids["label"]
    cover = labels.sparkSession.range(1).select(*[grids[s].coverage(target).alias(s) for s in ("radar", "optical")]).first()
    poor = {s: cover[s] for s in ("radar", "optical") if cover[s] < LEAST_FOOTPRINT}
    if poor:
        raise ContractError(f"sensor footprints cover too little of the label grid: {poor}")
    require(labels, {"label codes": F.col("label").isin(*LABELS)})
    blank = lambda c, kind: F.lit(None).cast(kind).alias(c)
    every = [*radar_bands, *optical_bands]

    def sensor(name: str, pixels: DataFrame, bands: list[str]) -> DataFrame:
        if grids[name].same(target):
            number = [F.col(b).cast("double") for b in bands]
            fine = F.coalesce(F.greatest(F.lit(True), *[v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in number]), F.lit(False))
            for v in number:
                fine = fine & F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
            rows = pixels.select(key, "px_row", "px_col", *[v.alias(b) for v, b in zip(number, bands, strict=True)], fine.alias("valid"))
        else:
            rows = on_grid(pixels, grids[name], target, bands, key=key, block=block)
        mine = {b: (reflectance(F.col(b)) if name == "optical" else F.col(b)).alias(b) for b in bands}
        flags = [F.col("valid").alias(f"{s}_valid") if s == name else blank(f"{s}_valid", "boolean") for s in ("radar", "optical")]
        return rows.select(key, "px_row", "px_col", blank("label", "int"), *[mine.get(b, blank(b, "double")) for b in every], *flags)

    base = labels.select(key, F.col("px_row").cast("bigint").alias("px_row"), F.col("px_col").cast("bigint").alias("px_col"), F.col("label").cast("int").alias("label"), *[blank(b, "double") for b in every], blank("radar_valid", "boolean"), blank("optical_valid", "boolean"))
    met = base.unionByName(sensor("radar", radar, radar_bands)).unionByName(sensor("optical", optical, optical_bands))
    one = met.groupBy(key, "px_row", "px_col").agg(
        F.count("label").alias("given"),
        F.max("label").alias("code"),
        *[F.max(b).alias(b) for b in every],
        *[F.coalesce(F.max(f"{s}_valid"), F.lit(False)).alias(f"{s}_valid") for s in ("radar", "optical")],
    )
    known = one.filter("given > 0")
    fine = known.withColumn("label", F.when(F.col("given") > 1, F.raise_error(F.lit("a label pixel is given twice"))).when(F.col("code") >= 0, F.col("code")))
    for s, bands in (("radar", radar_bands), ("optical", optical_bands)):
        fine = fine.withColumns({b: F.when(F.col(f"{s}_valid"), F.col(b)) for b in bands})
    paired = F.col("radar_valid") & F.col("optical_valid")
    return fine.select(key, "px_row", "px_col", "label", *every, "radar_valid", "optical_valid", paired.alias("paired_valid"), (paired & F.col("label").isNotNull()).alias("supervised"))


def quality(tiles: DataFrame, key: str = "tile_id") -> DataFrame:
    """Quality counts of canonical tiles, as their metadata hold them; cloud cover is not known."""
    return tiles.groupBy(key).agg(
        F.count_if(F.col("label").isNull()).alias("label_unknown"),
        F.count_if("radar_valid").alias("radar_valid"),
        F.count_if("optical_valid").alias("optical_nodata_valid"),
        F.count_if("paired_valid").alias("paired_sensor_valid"),
        F.count_if("supervised").alias("label_and_paired_valid"),
        F.lit(0).cast("bigint").alias("cloud_known"),
    )
