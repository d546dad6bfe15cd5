"""Plane geometry and map projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the transverse Mercator zone.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0


def to_utm(lon: Column, lat: Column, central_meridian: float = -3.0) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series to the fourth power of the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - central_meridian)
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * radius * east, SCALE * radius * north


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Sign of the turn from a over b to c."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def crosses(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments ``(x1, y1, x2, y2)`` properly cross; touching ends do not count."""
    first = orientation(a[0], a[1], a[2], a[3], b[0], b[1]) * orientation(a[0], a[1], a[2], a[3], b[2], b[3])
    second = orientation(b[0], b[1], b[2], b[3], a[0], a[1]) * orientation(b[0], b[1], b[2], b[3], a[2], a[3])
    return (first < 0) & (second < 0)


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Strict overlap of boxes ``(xmin, ymin, xmax, ymax)``; touching boxes do not overlap."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring, an array of ``struct(x, y)``, covers a point; the border counts."""
    sides = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def on_side(s: Column) -> Column:
        p, q = s["p"], s["q"]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    def to_the_right(s: Column) -> Column:
        p, q = s["p"], s["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        return spans & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"]) + p["x"])

    return F.exists(sides, on_side) | (F.size(F.filter(sides, to_the_right)) % 2 == 1)


def clip_to_box(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[Column, ...]) -> Column:
    """Part of a segment inside a box: struct of parameters ``t0`` and ``t1``, NULL when outside."""
    t0, t1, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, d, low, high in ((x1, x2 - x1, box[0], box[2]), (y1, y2 - y1, box[1], box[3])):
        flat = d == 0
        near = F.when(~flat, F.least((low - p) / F.nullif(d, F.lit(0.0)), (high - p) / F.nullif(d, F.lit(0.0))))
        far = F.when(~flat, F.greatest((low - p) / F.nullif(d, F.lit(0.0)), (high - p) / F.nullif(d, F.lit(0.0))))
        t0, t1 = F.greatest(t0, F.coalesce(near, F.lit(0.0))), F.least(t1, F.coalesce(far, F.lit(1.0)))
        inside = inside & (~flat | p.between(low, high))
    return F.when(inside & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def midpoints(length: Column, step: float) -> Column:
    """Sample places of a line of ``length``: array of ``struct(t, weight)`` at the middles of equal parts."""
    n = F.greatest(F.lit(1), F.ceil(length / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(((i + 0.5) / n).alias("t"), (length / n).alias("weight")))
