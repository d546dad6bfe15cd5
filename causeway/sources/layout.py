"""Parquet laid out along a space-filling curve, so that a box or a pointer opens few files.

A row has a box.  Its centre has a place on the Z-order curve over the extent of
the table; its size has a class, the depth of the smallest cells that are no
smaller than the box.  Files are cut from rows sorted by class, then place, so a
few long rows do not widen the files of the many short ones.  Beside the files
stand two small tables: borders of each file, and the greatest half-size of each
class.  A lookup grows its box by that half-size, splits it into ranges of the
curve and opens only files that a range and the file's own box both meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.spatial import nearest_link
from causeway.staging import stage

#: Halvings of the extent; a place has two bits for each.
BITS = 20
#: Ranges of the curve for each class of sizes; more are joined to wider ones, which admit more files, never fewer.
RANGES = 32
#: Files that a lookup names one by one; beyond it the folder is read with the same filter.
NAMED_FILES = 5_000
BOX = ("box_xmin", "box_ymin", "box_xmax", "box_ymax")
_OWN = (*BOX, "curve_place")
_CELLS = 1 << BITS


def _spread(cell: Column) -> Column:
    """The low 20 bits of ``cell`` with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
    return cell


def _cell(at: Column, low: float, side: float) -> Column:
    return F.least(F.lit(_CELLS - 1), F.greatest(F.lit(0), F.floor((at - low) / side * _CELLS))).cast("long")


def _interleaved(cx: int, cy: int) -> int:
    return sum(((cx >> k) & 1) << (2 * k) | ((cy >> k) & 1) << (2 * k + 1) for k in range(BITS))


def write_layout(rows: DataFrame, path: str, box: tuple[Column, Column, Column, Column], *, rows_per_file: int = 1_000_000) -> None:
    """Write ``rows`` with ``box`` (xmin, ymin, xmax, ymax) to ``path``, borders to ``path.files`` and ``path.classes``.

    Every row is written.  A box with a NULL, NaN or infinite side, or with its
    sides the wrong way round, is in no view; such rows come first and have no
    place.  Equal places are cut anywhere, so a hot spot fills many files.  An
    empty table gives empty tables.  A column named like one of the layout's own
    raises ``ValueError``, and so does an existing path.
    """
    clash = sorted(set(_OWN) & {c.lower() for c in rows.columns})
    if clash:
        raise ValueError(f"columns of the layout's own names: {', '.join(clash)}")
    spark = rows.sparkSession
    boxed = stage(rows.withColumns({n: c.cast("double") for n, c in zip(BOX, box)}), "layout-rows")
    x0, y0, x1, y1 = (F.col(n) for n in BOX)
    sound = F.coalesce((x0 <= x1) & (y0 <= y1) & (x0 > float("-inf")) & (y0 > float("-inf")) & (x1 < float("inf")) & (y1 < float("inf")), F.lit(False))
    low_x, low_y, high_x, high_y = boxed.filter(sound).agg(F.min(x0), F.min(y0), F.max(x1), F.max(y1)).first()
    low_x, low_y, side = (0.0, 0.0, 1.0) if low_x is None else (low_x, low_y, max(high_x - low_x, high_y - low_y) or 1.0)
    size = F.greatest(x1 - x0, y1 - y0)
    depth = F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(BITS), F.floor(F.log2(F.lit(side) / size))))).otherwise(BITS).cast("long")
    mid_x, mid_y = x0 + (x1 - x0) / 2, y0 + (y1 - y0) / 2
    curve = _spread(_cell(mid_x, low_x, side)) + F.shiftleft(_spread(_cell(mid_y, low_y, side)), 1)
    dealt = boxed.withColumn("curve_place", F.when(sound, F.shiftleft(depth, 2 * BITS) + curve))
    dealt = dealt.repartitionByRange("curve_place", F.xxhash64(*BOX, *[F.col(f"`{c}`") for c in rows.columns if _hashable(rows, c)]))
    dealt.sortWithinPartitions("curve_place").write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    placed = written.filter("curve_place is not null")
    half = F.greatest(mid_x - x0, x1 - mid_x), F.greatest(mid_y - y0, y1 - mid_y)
    files = placed.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("rows"), F.min("curve_place").alias("first"), F.max("curve_place").alias("last"), *[F.min(n).alias(n) for n in BOX[:2]], *[F.max(n).alias(n) for n in BOX[2:]]
    )
    files.write.parquet(f"{path}.files")
    classes = placed.groupBy(F.shiftright("curve_place", 2 * BITS).cast("int").alias("depth")).agg(F.count("*").alias("rows"), F.max(half[0]).alias("half_x"), F.max(half[1]).alias("half_y"))
    classes.withColumns({"low_x": F.lit(low_x), "low_y": F.lit(low_y), "side": F.lit(side)}).coalesce(1).write.parquet(f"{path}.classes")  # at most BITS + 1 rows


def _hashable(rows: DataFrame, name: str) -> bool:
    kind = rows.schema[name].dataType.simpleString()
    return "map<" not in kind and "variant" not in kind


def curve_ranges(low: tuple[int, int], high: tuple[int, int], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges (first, last) of the curve that cover the cells from ``low`` to ``high``, in order; about ``most`` at most."""
    found, front, depth = [], [(0, 0)], 0
    while front:
        edge = 1 << (BITS - depth)
        halved = []
        for cx, cy in front:
            x, y = cx * edge, cy * edge
            if x > high[0] or y > high[1] or x + edge <= low[0] or y + edge <= low[1]:
                continue
            if edge == 1 or (low[0] <= x and low[1] <= y and x + edge - 1 <= high[0] and y + edge - 1 <= high[1]):
                found.append((x, y, edge))
            else:
                halved.append((cx, cy))
        if len(found) + 4 * len(halved) > most:
            found += [(cx * edge, cy * edge, edge) for cx, cy in halved]
            halved = []
        front, depth = [(2 * cx + a, 2 * cy + b) for cx, cy in halved for a in (0, 1) for b in (0, 1)], depth + 1
    joined: list[tuple[int, int]] = []
    for first, last in sorted((_interleaved(x, y), _interleaved(x, y) + edge * edge - 1) for x, y, edge in found):
        if joined and first == joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], last)
        else:
            joined.append((first, last))
    return joined


def _view_ranges(classes: list, view: tuple[float, float, float, float]) -> list[tuple[int, int]]:
    """Ranges of (class, place) in which rows that meet ``view`` can lie."""
    out = []
    for c in classes:
        ends = []
        for low, high, start, half in ((view[0], view[2], c["low_x"], c["half_x"]), (view[1], view[3], c["low_y"], c["half_y"])):
            slack = 1e-14 * max(abs(start), abs(start + c["side"]), half)  # rounding of centres
            cells = [(max(min((v - start) / c["side"], 2.0), -1.0)) * _CELLS for v in (low - half - slack, high + half + slack)]
            ends.append((int(cells[0] // 1) - 1, int(cells[1] // 1) + 1))
        if any(e[1] < 0 or e[0] >= _CELLS + 1 for e in ends):
            continue
        low = tuple(min(max(e[0], 0), _CELLS - 1) for e in ends)
        high = tuple(min(max(e[1], 0), _CELLS - 1) for e in ends)
        base = c["depth"] << (2 * BITS)
        out += [(base + a, base + b) for a, b in curve_ranges(low, high)]
    return out


def in_view(spark: SparkSession, path: str, view: tuple[float, float, float, float]) -> DataFrame:
    """Rows of the layout whose box meets ``view`` (xmin, ymin, xmax, ymax); touching counts.

    Only files that can hold such rows are opened: ``inputFiles`` names them.
    A view with a NaN side or with sides the wrong way round raises ``ValueError``.
    """
    view = tuple(float(v) for v in view)
    if not (view[0] <= view[2] and view[1] <= view[3]):
        raise ValueError("a view needs xmin <= xmax and ymin <= ymax")
    whole = spark.read.parquet(path)
    ranges = _view_ranges(spark.read.parquet(f"{path}.classes").collect(), view)
    meets = (F.col(BOX[0]) <= view[2]) & (F.col(BOX[2]) >= view[0]) & (F.col(BOX[1]) <= view[3]) & (F.col(BOX[3]) >= view[1])
    names: list[str] = []
    if ranges:
        near = F.broadcast(spark.createDataFrame(ranges, "low long, high long"))  # RANGES for each class
        files = spark.read.parquet(f"{path}.files").filter(meets)
        files = files.join(near, (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low")), "left_semi")
        names = sorted(r["file"] for r in files.select("file").limit(NAMED_FILES + 1).collect())
    if not names:
        return spark.createDataFrame([], whole.schema).drop(*_OWN)
    source = whole if len(names) > NAMED_FILES else spark.read.schema(whole.schema).parquet(*[f"{path}/{n}" for n in names])
    return source.filter(meets & F.col("curve_place").isNotNull()).drop(*_OWN)


def link_under(spark: SparkSession, path: str, x: float, y: float, *, limit: float, x_scale: float = 1.0) -> DataFrame:
    """The nearest segment of a layout of ``(segment_id, ax, ay, bx, by_)`` within ``limit`` of a pointer, as ``nearest_link`` over all rows gives it.

    The search looks around the pointer and doubles its reach until the reach holds
    a segment or is the limit, so a near one is found in few files.
    """
    if not limit >= 0 or not x_scale > 0:
        raise ValueError("limit must not be negative and x_scale must be positive")
    reach = limit / 64
    while True:
        reach = min(reach * 2, limit)
        wide = reach * (1 + 1e-9)
        near = in_view(spark, path, (x - wide / x_scale, y - wide, x + wide / x_scale, y + wide))
        found = nearest_link(near, x, y, limit=reach, x_scale=x_scale)
        if reach >= limit or not found.isEmpty():
            return found
