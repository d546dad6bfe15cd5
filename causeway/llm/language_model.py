"""Operator 9: language-model scoring by context-tree weighting.

A byte is eight binary decisions, each with a context tree over the ``depth``
bytes before it.  Every node of a tree holds a Krichevsky-Trofimov estimate of
its bit counts, and weighting mixes the estimates of all depths: a node's
probability is half its own estimate and half the product of its children's.
The tree is learnt from the training texts and then fixed, so the probability of
a byte depends on the bytes before it alone, and each distinct (depth + 1)-gram
has one code length.

Tasks count n-grams and words of their texts; Spark sums them, builds the levels
of the trees from the deepest up and the mixtures from the root down.  Texts are
scored against a head of at most ``HEAD`` frequent entries that every executor
holds; rarer entries are joined.  Both together are all entries.

Cases
* null text counts as empty: its only token, and only byte, is the end;
* a null id belongs to the training part;
* with no training text every token has probability 1 in the base score and
  every bit one half in the model;
* repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.lookup import Lookup
from causeway.llm.staging import stage
from causeway.llm.textkit import LOWER, SPACED, Chunk, chunks, words

DEPTH = 4
#: Entries of the words and of the n-grams that are sent to every executor (16 bytes each).
HEAD = 400_000
#: Entries that a counting task merges before it hands them on.
MERGED = 1_000_000
END = 255
_WORD, _GRAM = 0, 1


def held_out(id_column: Column, parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == part, F.lit(False))


def grams(chunk: Chunk, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(depth + 1)-grams that end at each byte and at the end of each text, and offsets of the texts."""
    rows = chunk.rows
    size = np.diff(chunk.ends)
    owner = np.repeat(np.arange(rows), size)
    padded = np.full(len(data) + rows * (depth + 1), END, dtype=np.uint8)
    padded[np.arange(len(data)) + owner * (depth + 1) + depth] = data
    key = np.zeros(len(padded) - depth, dtype=np.uint64)
    for k in range(depth + 1):
        key = (key << np.uint64(8)) | padded[k : k + len(key)]
    ends = chunk.ends + np.arange(rows + 1)
    own = np.repeat(np.arange(rows), np.diff(ends))
    return key[np.arange(ends[-1]) + own * depth], ends


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


class _Counts:
    """Sums of training and all counts by key."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray, train: bool) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n if train else np.zeros_like(n), n))
        self.size += len(found)
        if self.size > MERGED:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_summed(*(np.concatenate(column) for column in zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, train, every in self.parts:
            for at in range(0, len(keys), 100_000):
                cut = slice(at, at + 100_000)
                own = keys[cut].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), self.kind, dtype=np.int32)), pa.array(own), pa.array(train[cut]), pa.array(every[cut])], names=["kind", "key", "n", "n_all"]
                )
        self.parts, self.size = [], 0


def _counter(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {_WORD: _Counts(_WORD), _GRAM: _Counts(_GRAM)}
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                data = LOWER[chunk.data]
                out = held[chunk.first : chunk.first + chunk.rows]
                tokens = words(data, chunk.ends, SPACED)
                found[_WORD].add(tokens.key[~np.repeat(out, np.diff(tokens.ends))], True)
                key, ends = grams(chunk, data, depth)
                own = np.repeat(out, np.diff(ends))
                found[_GRAM].add(key[~own], True)
                if own.any():
                    found[_GRAM].add(key[own], False)
            for part in found.values():
                if part.size > MERGED:
                    yield from part.rows()
        for part in found.values():
            yield from part.rows()

    return run


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5 (Stirling's series at x + 8)."""
    shifted = x + 8
    below = x
    for k in range(1, 8):
        below = below * (x + k)
    square = shifted * shifted
    series = (1 / 12.0 - (1 / 360.0 - (1 / 1260.0 - (1 / 1680.0) / square) / square) / square) / shifted
    return (shifted - 0.5) * F.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def _log_kt(a: Column, b: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - math.log(math.pi) - _log_gamma(a + b + 1.0)


def _weighted(level: DataFrame, deepest: bool) -> DataFrame:
    """Add the weighted probability ``lw`` and the own estimate's share ``own`` of each node."""
    out = level.withColumn("kt", _log_kt(F.col("a").cast("double"), F.col("b").cast("double")))
    if deepest:
        return out.select("context", "node", "a", "b", F.col("kt").alias("lw"), F.lit(1.0).alias("own"))
    top = F.greatest("kt", "below")
    out = out.withColumn("lw", top + F.log(F.exp(F.col("kt") - top) + F.exp(F.col("below") - top)) - math.log(2))
    return out.select("context", "node", "a", "b", "lw", F.exp(F.col("kt") - F.col("lw") - math.log(2)).alias("own"))


def _bits(frame: DataFrame) -> DataFrame:
    """Eight rows per gram: the context, the decision node of each bit, and the bit."""
    byte = F.col("key").bitwiseAND(F.lit(255))
    out = frame.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("byte", byte.cast("int"))
    return out.withColumns(
        {
            "context": F.shiftrightunsigned("key", 8),
            "node": F.expr("shiftleft(1, k) | shiftrightunsigned(byte, 8 - k)"),
            "bit": F.expr("shiftrightunsigned(byte, 7 - k) & 1"),
        }
    )


def code_lengths(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Log10 probability ``lp`` of each gram of ``counted(key, n, n_all)`` under the weighted trees."""
    leaf = _bits(counted).groupBy("context", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("b"))
    levels = [stage(_weighted(leaf, True), "op9-level")]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        up = levels[0].groupBy(shorter.alias("context"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below"))
        levels.insert(0, stage(_weighted(up, False), "op9-level"))
    ones = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    mixed = levels[0].select("context", "node", (F.col("own") * ones).alias("so_far"), (1 - F.col("own")).alias("rest"))
    for d in range(1, depth + 1):
        above = mixed.select(F.col("context").alias("c"), F.col("node").alias("d"), "so_far", "rest")
        if d <= 2:  # at most 255 nodes in each of 256 contexts
            above = F.broadcast(above)
        shorter = F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))
        down = levels[d].join(above, (shorter == F.col("c")) & (F.col("node") == F.col("d")))
        mixed = down.select("context", "node", (F.col("so_far") + F.col("rest") * F.col("own") * ones).alias("so_far"), (F.col("rest") * (1 - F.col("own"))).alias("rest"))
    last = mixed.select(F.col("context").alias("c"), F.col("node").alias("d"), F.col("so_far").alias("p"))
    joined = _bits(counted).join(last, (F.col("context") == F.col("c")) & (F.col("node") == F.col("d")))
    chance = F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return joined.groupBy("key").agg(F.sum(F.log10(chance)).alias("lp"), F.first("n_all").alias("n_all"))


def _head(table: DataFrame, count: str) -> int:
    """Least power of two such that at most ``HEAD`` entries are counted so often."""
    sizes = table.groupBy(F.floor(F.log2(count)).cast("int").alias("power")).count().collect()  # at most 64 rows
    total, least = 0, 64
    for row in sorted(sizes, key=lambda r: -r["power"]):
        total += row["count"]
        if total > HEAD:
            break
        least = row["power"]
    return 1 if sum(r["count"] for r in sizes) <= HEAD else 1 << least


def _sent(table: DataFrame, value: str):
    """A token and the broadcast of a head table, which holds at most ``HEAD`` rows."""
    rows = table.select("key", value).toArrow()
    keys = rows.column("key").to_numpy() if rows.num_rows else np.zeros(0, dtype=np.int64)
    values = rows.column(value).to_numpy() if rows.num_rows else np.zeros(0)
    order = np.argsort(keys)
    return uuid.uuid4().hex, table.sparkSession.sparkContext.broadcast((keys[order].view(np.uint64), values[order].astype(np.float64)))


_READY: dict[str, Lookup] = {}


def _lookup(sent) -> Lookup:
    """Lookup of a sent table, built once in each Python worker and known by the token that the driver drew."""
    token, table = sent
    if token not in _READY:
        if len(_READY) >= 2:
            _READY.clear()
        _READY[token] = Lookup(*table.value)
    return _READY[token]


def _scorer(depth: int, word_head, gram_head, words_whole: bool, grams_whole: bool, unknown: float, end: float, end_known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = _lookup(word_head), _lookup(gram_head)
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                data = LOWER[chunk.data]
                rows = chunk.rows
                tokens = words(data, chunk.ends, SPACED)
                n = np.diff(tokens.ends)
                owner = np.repeat(np.arange(rows), n)
                place = vocabulary.find(tokens.key)
                known = place >= 0
                gain = np.where(known, vocabulary.values[np.maximum(place, 0)] if len(vocabulary.values) else 0.0, unknown if words_whole else 0.0)
                base = np.bincount(owner, gain, minlength=rows) + end
                n_known = np.bincount(owner[known], minlength=rows) + end_known
                rare = np.zeros(0, dtype=np.int64) if words_whole else np.flatnonzero(~known)
                key, ends = grams(chunk, data, depth)
                own = np.repeat(np.arange(rows), np.diff(ends))
                spot = model.find(key)
                there = spot >= 0
                score = np.bincount(own, np.where(there, model.values[np.maximum(spot, 0)] if len(model.values) else 0.0, 0.0), minlength=rows)
                rare_gram = np.zeros(0, dtype=np.int64) if grams_whole else np.flatnonzero(~there)
                part = slice(chunk.first, chunk.first + rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        batch.column(1)[part],
                        pa.array((n + 1).astype(np.int64)),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(base),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[rare], np.arange(rows + 1)), pa.int32()), pa.array(tokens.key[rare].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(own[rare_gram], np.arange(rows + 1)), pa.int32()), pa.array(key[rare_gram].view(np.int64))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare_words", "rare_grams"],
                )

    return run


def scores(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Base and model score of every row.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` (log10 of the probability of
    the lower-cased bytes and the end).
    """
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = source.select("held_out", "text").mapInArrow(_counter(depth), "kind int, key long, n long, n_all long")
    counted = stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")), "op9-counts")
    word = counted.filter(F.col("kind") == _WORD).select("key", "n")
    totals = word.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = source.filter("not held_out").count()
    train, distinct = totals["n"] + texts, totals["v"] + (texts > 0)
    whole = train + 0.5 * (distinct + 1)
    gram = stage(code_lengths(counted.filter(F.col("kind") == _GRAM).select("key", "n", "n_all"), depth), "op9-model")
    word = word.withColumn("lp", F.log10((F.col("n") + 0.5) / whole))
    often, common = _head(word, "n"), _head(gram, "n_all")
    unknown = math.log10(0.5 / whole)
    scorer = _scorer(
        depth, _sent(word.filter(F.col("n") >= often), "lp"), _sent(gram.filter(F.col("n_all") >= common), "lp"), often == 1, common == 1, unknown, math.log10((texts + 0.5) / whole), int(texts > 0)
    )
    scored = source.mapInArrow(scorer, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare_words array<long>, rare_grams array<long>")
    if often > 1 or common > 1:
        scored = stage(scored.withColumn("rid", F.monotonically_increasing_id()), "op9-scored")
        rare_words = scored.select("rid", F.explode("rare_words").alias("key")).join(word.filter(F.col("n") < often), "key", "left")
        rare_grams = scored.select("rid", F.explode("rare_grams").alias("key")).join(gram.filter(F.col("n_all") < common), "key", "left")
        more = (
            rare_words.select("rid", F.col("lp").isNotNull().cast("long").alias("known"), F.coalesce("lp", F.lit(unknown)).alias("b"), F.lit(0.0).alias("s"))
            .union(rare_grams.select("rid", F.lit(0).cast("long"), F.lit(0.0), "lp"))
            .groupBy("rid")
            .agg(F.sum("known").alias("known"), F.sum("b").alias("b"), F.sum("s").alias("s"))
        )
        scored = scored.join(more, "rid", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
        )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(train)).cast("long").alias("train_tokens"), "base_score", "score")
