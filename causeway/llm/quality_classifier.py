"""Operator 4: a quality classifier on random Fourier features.

Statistics of a text are standardised and mapped to random cosines, whose inner
products approximate a Gaussian kernel.  Every partition sums its share of the
normal equations of ridge regression on the labels, Spark adds the sums, and the
driver solves a system whose size is fixed.  Isotonic regression over a fixed
grid of raw scores turns them into probabilities; it is fitted on rows that the
ridge regression has not seen, one in ``SPARE`` by a hash of the id.

All labelled rows that may be learnt from are used; all texts are read whole.

Cases
* null or empty texts have statistics of zero and are scored like others;
* a null id is not held out; rows without a label are only scored;
* without any label, every score is one half; where all labelled rows fall into one
  part, that part serves both fits;
* repeated rows count as often as they stand; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.staging import stage
from causeway.llm.textkit import LOWER, SPACED, chunks, mix, shingles, words

COSINES = 128
SEED = 20240607
#: Width of the Gaussian kernel in standardised units.
WIDTH = 4.0
RIDGE = 1e-3
#: Cells of the grid on which raw scores are calibrated, from -1 to 2.
CELLS = 600
CLIP = 6.0
#: One labelled row in so many is kept for the calibration.
SPARE = 4

STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "mark", "wide", "space", "lines", "distinct", "repeated", "lone", "long_words"]

_UPPER, _DIGIT, _SYMBOL, _MARK, _WIDE = (np.zeros(256, dtype=np.float32) for _ in range(5))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~=_{}[]\\"]] = 1
_MARK[[ord(c) for c in "!?;:\"'()-/"]] = 1
_WIDE[128:] = 1


def held_out(id_column: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == part, F.lit(False))


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text of a chunk."""
    rows = len(ends) - 1
    size = np.diff(ends).astype(np.float64)
    found = words(data, ends, SPACED)
    count = np.diff(found.ends).astype(np.float64)
    owner = np.repeat(np.arange(rows), np.diff(found.ends))
    length = (found.stop - found.start).astype(np.float64)
    some, many = np.maximum(size, 1), np.maximum(count, 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(table[data], dtype=np.float64)])
        return (total[ends[1:]] - total[ends[:-1]]) / some

    line = np.zeros(256, dtype=np.float32)
    line[10] = 1
    folded = words(LOWER[data], ends, SPACED)
    runs, run_ends = shingles(folded, 3)
    return np.stack(
        [
            np.log1p(size),
            np.log1p(count),
            np.bincount(owner, length, minlength=rows) / many,
            share(_UPPER),
            share(_DIGIT),
            share(_SYMBOL),
            share(_MARK),
            share(_WIDE),
            1 - np.bincount(owner, length, minlength=rows) / some,
            share(line),
            _distinct(folded.key, folded.ends) / many,
            1 - _distinct(runs, run_ends) / np.maximum(np.diff(run_ends), 1),
            np.bincount(owner, length == 1, minlength=rows) / many,
            np.bincount(owner, length > 14, minlength=rows) / many,
        ],
        axis=1,
    )


def _distinct(key: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distinct keys of each text."""
    owner = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
    tagged = mix(key + owner * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(tagged)
    near = tagged[order]
    first = np.concatenate([[True], near[1:] != near[:-1]]) if len(near) else np.zeros(0, dtype=bool)
    return np.bincount(owner[order[first]].astype(np.int64), minlength=len(ends) - 1).astype(np.float64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(2)):
            table = statistics(chunk.data, chunk.ends)
            rows = slice(chunk.first, chunk.first + chunk.rows)
            ends = np.arange(chunk.rows + 1, dtype=np.int32) * table.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[rows], batch.column(1)[rows], pa.ListArray.from_arrays(pa.array(ends), pa.array(table.reshape(-1)))], names=["doc_id", "held_out", "x"]
            )


class Model:
    """Standardisation, random cosines, ridge weights and the calibration grid."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.waves = rng.normal(scale=1 / WIDTH, size=(len(mean), COSINES))
        self.phases = rng.uniform(0, 2 * np.pi, COSINES)
        self.weights = np.zeros(COSINES + 1)
        self.grid, self.level = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([np.ones((len(x), 1)), np.cos(z @ self.waves + self.phases) * np.sqrt(2 / COSINES)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.grid, self.level), 0.0, 1.0)


def _table(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def _equations(model: Model):
    """Sums of a partition: the matrix rows of features by features, the target last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COSINES + 1, COSINES + 2))
        for batch in batches:
            x, y = _table(batch.column(0)), batch.column(1).to_numpy().astype(np.float64)
            z = model.features(x)
            total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, j].copy()) for j in range(total.shape[1]))], names=["i", *(f"c{j}" for j in range(total.shape[1]))])

    return run


def _raw_cells(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.clip((model.raw(_table(batch.column(0))) + 1) * (CELLS / 3), 0, CELLS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "quality"])

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_table(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def isotonic(cell: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over grid cells; centres and levels of the pooled blocks."""
    blocks: list[list[float]] = []
    for c, n, g in sorted(zip(cell, total, good)):
        blocks.append([c * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    centre = np.array([b[0] / b[1] for b in blocks])
    return (centre + 0.5) * (3 / CELLS) - 1, np.array([b[2] / b[1] for b in blocks])


def fit(measured: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", label: str = "quality") -> Model:
    """Train from the labelled rows of ``measured(doc_id, held_out, x)`` that are not held out."""
    known = labels.select(F.col(label_id).alias("l_id"), F.col(label).cast("int").alias("quality")).filter(F.col("quality").isin(0, 1))
    rows = measured.filter("not held_out").join(known, F.col("doc_id") == F.col("l_id")).select("x", "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(SPARE)) == 0).alias("spare"))
    every = stage(rows, "op4-labelled")
    rows, spare = every.filter("not spare"), every.filter("spare")
    parts = {r["spare"] for r in every.select("spare").distinct().collect()}  # at most two rows
    if len(parts) == 1:
        rows = spare = every
    k = len(STATISTICS)
    moments = rows.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(k)], *[F.stddev_pop(F.col("x")[j]).alias(f"s{j}") for j in range(k)]).first()
    if not moments["n"]:
        return Model(np.zeros(k), np.ones(k))
    model = Model(np.array([moments[f"m{j}"] for j in range(k)]), np.maximum([moments[f"s{j}"] for j in range(k)], 1e-3))
    names = [f"c{j}" for j in range(COSINES + 2)]
    sums = rows.select("x", "quality").mapInArrow(_equations(model), "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    table = np.stack([sums.column(c).to_numpy() for c in names], axis=1)[np.argsort(sums.column("i").to_numpy())]
    penalty = RIDGE * moments["n"] * np.eye(COSINES + 1)
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(table[:, :-1] + penalty, table[:, -1])
    cells = spare.select("x", "quality").mapInArrow(_raw_cells(model), "cell int, quality int").groupBy("cell").agg(F.count("*").alias("n"), F.sum("quality").alias("good")).toArrow()
    model.grid, model.level = isotonic(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), cells.column("good").to_numpy())
    return model


def scores(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Quality of every row: ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), F.col(text).cast("string").alias("text"))
    measured = stage(source.mapInArrow(_measured, f"doc_id {kind}, held_out boolean, x array<double>"), "op4-statistics")
    model = fit(measured, labels, **options)
    return measured.mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
