"""Operator 13: near-duplicate vectors by tile products of int8 codes.

Every vector x of length 1 is coded as x = s q + e with integers |q| <= 127 and the
exact error length |e|.  For two vectors

    |x.y - s_x s_y q_x.q_y| <= |s_x q_x| |e_y| + |e_x| |y|,

so a tile product of the codes (exact, as integers below 2 ** 24 in single
precision) tells which pairs are surely linked, surely not, or must be computed
again in double precision from the original numbers.  Only the last are.

Vectors are packed in units, ordered by the nearest of a few pivots, and units in
blocks.  Blocks meet in tiles; a tile is left out when the angle between the
centres of its blocks, less the reach of both, exceeds that of the threshold, which
no linked pair can do.  A tile returns per vector how many links it has and a
spanning forest of them, never the pairs.  Equal vectors stand as one row with a count.

Work is quadratic in the number of different vectors where the blocks do not
lie apart; nothing is dropped to avoid it.

Cases
-----
* Vectors that are null, empty, zero, or hold a null or non-finite component link
  with nothing.  Vectors of different dimension do not link.
* Repeated rows are vectors of their own: they link with each other.  A null id
  counts as a link, but never as the least id of a component.
* No rows give no rows.  Of extra columns only those named in ``carry`` come out.
* Very long vectors are multiplied in slices of 1,000 components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.links import components, is_few, salted
from causeway.staging import stage

SIMILAR = 0.9
#: Vectors in a unit (one row of the packed table) and units in a block.
UNIT = 512
UNITS = 16
#: Vectors that order the others; more only makes blocks tighter.
PIVOTS = 64
#: Rows of a tile that are multiplied at once, pairs that are computed again at once.
SLICE = 1024
AGAIN = 20_000
#: Components of a product that single precision sums exactly: 1000 * 127 ** 2 < 2 ** 24.
EXACT = 1000
#: Slack for rounding in the bounds, far above that of double precision.
ROUND = 1e-5


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths in double precision, scaled to length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return unit_length(x)


def unit_length(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(pivots: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pivot of each vector and closeness to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            best, close = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                near = _matrix(batch.column(1).take(pa.array(at))) @ pivots[int(dim)].T if int(dim) in pivots else np.ones((len(at), 1))
                best[at], close[at] = near.argmax(axis=1), near.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(close)], names=["rid", "vector", "dim", "copies", "pivot", "close"])

    return run


_UNIT = "block long, unit int, dim int, n int, rid binary, copies binary, codes binary, scale binary, error binary, unit_vector binary"


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of rows of length 1, their scales and the lengths of the errors."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the ordered vectors of a task in units, and count the units of each block."""
    block, unit, last = TaskContext.get().partitionId() << 32, 0, None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]

    def packed() -> pa.RecordBatch:
        nonlocal unit, block
        rid, copies, x = (np.concatenate(c) for c in zip(*held, strict=True))
        codes, scale, error = coded(x)
        row = [block, unit, x.shape[1], len(rid), rid.tobytes(), copies.tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes(), x.tobytes()]
        held.clear()
        unit += 1
        if unit == UNITS:
            unit, block = 0, block + 1
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _UNIT.split(", ")])

    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):  # rows come ordered by dimension
            at = np.flatnonzero(dims == dim)
            if last is not None and last != dim:
                if held:
                    yield packed()
                unit, block = 0, block + (unit > 0)
            last = dim
            rid, copies = batch.column(0).to_numpy()[at], batch.column(3).to_numpy()[at]
            x = _matrix(batch.column(1).take(pa.array(at)))
            while len(rid):
                room = UNIT - sum(len(h[0]) for h in held)
                held.append((rid[:room], copies[:room], x[:room]))
                rid, copies, x = rid[room:], copies[room:], x[room:]
                if sum(len(h[0]) for h in held) == UNIT:
                    yield packed()
    if held:
        yield packed()


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of each unit."""
    for batch in batches:
        for k in range(batch.num_rows):
            dim = batch.column(2)[k].as_py()
            x = np.frombuffer(batch.column(3)[k].as_py(), np.float64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64()))], names=["block", "dim", "total"])


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Largest angle of a unit's vectors to the centre of its block."""
    for batch in batches:
        for k in range(batch.num_rows):
            centre = np.asarray(batch.column(1)[k].as_py())
            x = np.frombuffer(batch.column(2)[k].as_py(), np.float64).reshape(-1, len(centre))
            angle = np.arccos(np.clip(x @ centre, -1, 1)).max()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([float(angle)])], names=["block", "reach"])


class _Side:
    """Vectors of one side of a tile."""

    def __init__(self, table: pa.Table):
        dim = table.column("dim")[0].as_py()

        def joined(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(v.as_py(), kind) for v in table.column(name)])

        self.rid, self.copies = joined("rid", np.int64), joined("copies", np.int64)
        self.codes = joined("codes", np.int8).reshape(-1, dim).astype(np.float32)
        self.scale, self.error = joined("scale", np.float64), joined("error", np.float64)
        self.x = joined("unit_vector", np.float64).reshape(-1, dim)
        self.length = np.sqrt(((self.codes.astype(np.float64) * self.scale[:, None]) ** 2).sum(axis=1))


def linked(left: _Side, right: _Side, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of the pairs with cosine of at least ``least``."""
    dim = left.codes.shape[1]
    scale = right.scale.astype(np.float32)[None, :]
    widest = right.error.max()
    for at in range(0, len(left.rid), SLICE):
        cut = slice(at, at + SLICE)
        product = left.codes[cut, :EXACT] @ right.codes[:, :EXACT].T
        if dim > EXACT:
            product = product.astype(np.float64)
            for k in range(EXACT, dim, EXACT):
                product += left.codes[cut, k : k + EXACT] @ right.codes[:, k : k + EXACT].T
        product *= scale
        # a bound for the whole row first: no error of the right side is wider than the widest
        low = (least - ROUND - left.error[cut] - left.length[cut] * widest) / left.scale[cut]
        i, j = np.nonzero(product >= low.astype(product.dtype)[:, None])
        near = product[i, j].astype(np.float64) * left.scale[cut][i]
        slack = left.length[cut][i] * right.error[j] + left.error[cut][i] + ROUND
        sure = near - slack >= least
        open_ = np.flatnonzero(~sure & (near + slack >= least))
        for k in range(0, len(open_), AGAIN):
            some = open_[k : k + AGAIN]
            cosine = np.einsum("ij,ij->i", left.x[cut][i[some]], right.x[j[some]])
            sure[some] = cosine >= least
        yield i[sure] + at, j[sure]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least vertex of each component of the edges (a, b) over n vertices."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _tile(least: float) -> Callable[[pa.Table], pa.Table]:
    """Links of each vector of a tile and the least row that they lead to inside it."""

    def run(table: pa.Table) -> pa.Table:
        one, other = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        block = table.column("block").to_numpy()
        left = _Side(table.filter(pa.array(block == one)))
        right = left if one == other else _Side(table.filter(pa.array(block == other)))
        size = len(left.rid)
        rid = left.rid if one == other else np.concatenate([left.rid, right.rid])
        links = np.zeros(len(rid), np.int64)
        label = np.arange(len(rid))
        for i, j in linked(left, right, least):
            if one == other:
                i, j = i[i != j], j[i != j]
                links += np.bincount(i, right.copies[j], len(rid)).astype(np.int64)
            else:
                links += np.bincount(i, right.copies[j], len(rid)).astype(np.int64)
                j = j + size
                links += np.bincount(j, left.copies[i], len(rid)).astype(np.int64)
            label = _forest(np.concatenate([i, np.arange(len(rid))]), np.concatenate([j, label]), len(rid))
        some = np.flatnonzero(links)
        return pa.table({"rid": rid[some], "links": links[some], "root": rid[label[some]]})

    return run


def _tiles(blocks: DataFrame, least: float) -> DataFrame:
    """Blocks that may hold linked vectors, as ``(block, low, high)``, a row for each block of a tile."""
    summed = blocks.select("block", "unit", "dim", "unit_vector").mapInArrow(_spans, "block long, dim int, total array<double>")
    totals = summed.select("block", "dim", F.posexplode("total").alias("at", "v")).groupBy("block", "dim", "at").agg(F.sum("v").alias("v"))
    centres = totals.groupBy("block", "dim").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c")).select("block", "dim", F.col("c.v").alias("c"))  # one entry a dimension
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    centres = stage(centres.withColumn("centre", F.when(size > 0, F.transform("c", lambda x: x / size)).otherwise(F.col("c"))).select("block", "dim", "centre"), "op13-centres")
    reach = blocks.select("block", "unit_vector").join(centres.select("block", "centre"), "block").select("block", "centre", "unit_vector").mapInArrow(_reaches, "block long, reach double")
    spans = stage(centres.join(reach.groupBy("block").agg(F.max("reach").alias("reach")), "block"), "op13-spans")
    low = spans.select(F.col("block").alias("low"), "dim", F.col("centre").alias("a"), F.col("reach").alias("ra"))
    high = spans.select(F.col("block").alias("high"), "dim", F.col("centre").alias("b"), F.col("reach").alias("rb"))
    between = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.aggregate(F.zip_with("a", "b", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x))))
    met = low.join(high, "dim").filter((F.col("low") <= F.col("high")) & (between - F.col("ra") - F.col("rb") <= F.acos(F.lit(least)) + 1e-6))
    return met.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("block"), "low", "high")


def _pivots(reps: DataFrame) -> dict[int, np.ndarray]:
    """``PIVOTS`` vectors of the commonest dimension, those of the least hash; they order rows and decide no link."""
    common = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return {}
    few = reps.filter(F.col("dim") == common["dim"]).select("vector").orderBy(F.xxhash64("vector"), "vector").limit(PIVOTS).toArrow()
    return {common["dim"]: _matrix(few.column(0))}


def near_vectors(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", least: float = SIMILAR, carry: list[str] | None = None) -> DataFrame:
    """Number of links and component of every vector.

    Returns a row per row of ``vectors``: the id, ``n_links`` (other vectors with a
    cosine of at least ``least``), ``component_id`` (the least id that links lead
    to) and ``kept`` (whether the row's id is it); columns in ``carry`` come along as
    a struct ``row``.  ``least`` is above 0.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), *carried)
    usable = _usable(F.col("vector"))
    rows = rows.select("*", F.when(usable, F.xxhash64("vector")).alias("ka"), F.when(usable, F.xxhash64(F.lit(1), "vector")).alias("kb"), F.monotonically_increasing_id().alias("rid"))
    rows = stage(rows, "op13-rows")
    # equal hashes of 128 bits stand for equal vectors
    groups = rows.filter("ka is not null").groupBy("ka", "kb").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    groups = stage(groups, "op13-groups")
    reps = stage(rows.select("rid", "vector").join(groups.select(F.col("rep").alias("rid"), "copies"), "rid").select("rid", "vector", F.size("vector").alias("dim"), "copies"), "op13-distinct")
    dealt = reps.mapInArrow(_nearest(_pivots(reps)), f"rid long, vector {reps.schema['vector'].dataType.simpleString()}, dim int, copies long, pivot int, close double")
    dealt = dealt.repartitionByRange("dim", "pivot", "close", "rid").sortWithinPartitions("dim", "pivot", "close", "rid")
    blocks = stage(dealt.select("rid", "vector", "dim", "copies").mapInArrow(_units, _UNIT), "op13-units")
    tiles = stage(_tiles(blocks, least), "op13-tiles")
    met = blocks.join(tiles, "block").groupBy("low", "high").applyInArrow(_tile(least), "rid long, links long, root long")
    found = stage(met, "op13-links")
    labels = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")).filter("a <> b"), "op13")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    told = groups.join(counts, F.col("rep") == F.col("rid"), "left").drop("rid").join(labels, F.col("rep") == F.col("v"), "left").select("ka", "kb", "copies", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "rep").alias("label"))
    told = stage(told, "op13-told")
    whole = told.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    whole = stage(whole, "op13-whole")
    told = told.join(F.broadcast(whole), "label", "left") if is_few(whole) else salted(told, whole, ["label"], "ka")
    told = told.select("ka", "kb", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = salted(rows.drop("vector"), told, ["ka", "kb"], "rid")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), *(["row"] if carry else []))
