"""Operator 2: benchmark decontamination by a prefix-filtered containment join.

Every run of ten consecutive words of a benchmark item is a window (a shorter
item is one window).  A document contains a window when it has the same words in
the same order.  Words are ordered by how rare they are in the corpus; as all
words of a window must match, its rarest word alone is the necessary prefix.
Only where a document has a prefix word is a window tried: the word's place in
the window fixes where the window starts (positional bound), the whole window
must fit into the text (length bound), and then all its words are compared.

Equal windows are one window with a list of items, so a passage that many items
share is tried once.  Where a frequent word is the rarest of many windows, they are
tried in slices of ``SLICE``, so memory stays bounded.

The index of windows goes to executors in blocks of at most ``BLOCK_BYTES`` of
benchmark text; a larger benchmark is joined block after block, and only rows with
hits are brought together.

Cases
* null or empty texts and items have no words;
* items with the same id count once, items with a null id never count in
  ``items`` but their windows do hit;
* repeated rows of documents get equal results;
* extra columns are ignored by :func:`contamination` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.staging import stage
from causeway.llm.textkit import LOWER, PLAIN, chunks, words

WINDOW = 10
BLOCK_BYTES = 8_000_000
#: Windows that are tried at a time.
SLICE = 500_000


@dataclass
class Index:
    """Distinct windows of a block of items: their words' numbers and items, and windows by prefix word."""

    vocabulary: np.ndarray
    window: np.ndarray
    length: np.ndarray
    item_ends: np.ndarray
    item: np.ndarray
    names: list[str | None]
    prefix_ends: np.ndarray
    prefix_window: np.ndarray
    prefix_place: np.ndarray


def numbered(key: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted ``vocabulary``, or -1."""
    if not len(vocabulary) or not len(key):
        return np.full(len(key), -1, dtype=np.int64)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[vocabulary & np.uint64(0xFFFF)] = True
    out = np.full(len(key), -1, dtype=np.int64)
    near = np.flatnonzero(maybe[key & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(vocabulary, key[near]), len(vocabulary) - 1)
    same = vocabulary[at] == key[near]
    out[near[same]] = at[same]
    return out


def item_windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of each distinct window (padded with 0), its length, and offsets and places of its items."""
    rows, lengths, owners = [], [], []
    for chunk in chunks(texts):
        found = words(LOWER[chunk.data], chunk.ends, PLAIN)
        for i in range(chunk.rows):
            key = found.key[found.ends[i] : found.ends[i + 1]]
            size = min(len(key), WINDOW)
            if size:
                cut = np.unique(np.lib.stride_tricks.sliding_window_view(key, size), axis=0)
                padded = np.zeros((len(cut), WINDOW), dtype=np.uint64)
                padded[:, :size] = cut
                rows.append(padded)
                lengths.append(np.full(len(cut), size))
                owners.append(np.full(len(cut), chunk.first + i))
    if not rows:
        return np.zeros((0, WINDOW), dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    every, length, owner = np.concatenate(rows), np.concatenate(lengths), np.concatenate(owners)
    order = np.lexsort((owner, *every.T[::-1], length))
    every, length, owner = every[order], length[order], owner[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = (length[1:] != length[:-1]) | (every[1:] != every[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return every[first], length[first], np.append(first, len(every)), owner


def build_index(names: list[str | None], texts: pa.Array, vocabulary: np.ndarray, seen: np.ndarray) -> Index:
    """Order the words of each window by ``seen``, their count in the corpus, and index the rarest."""
    keys, length, item_ends, item = item_windows(texts)
    inside = np.arange(WINDOW)[None, :] < length[:, None]
    number = np.where(inside, np.searchsorted(vocabulary, keys).clip(0, max(len(vocabulary) - 1, 0)), -1)
    count = np.where(inside, seen[number] if len(seen) else 0, np.iinfo(np.int64).max)
    place = np.argmin(count, axis=1) if len(count) else np.zeros(0, dtype=np.int64)
    prefix = number[np.arange(len(number)), place]
    order = np.argsort(prefix, kind="stable")
    ends = np.searchsorted(prefix[order], np.arange(len(vocabulary) + 1))
    return Index(vocabulary, number, length, item_ends, item, names, ends, order, place[order])


def occurrences(index: Index, number: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start words and windows of all occurrences in texts of word ``number`` with word offsets ``ends``."""
    spot = np.flatnonzero(number >= 0)
    tried = index.prefix_ends[number[spot] + 1] - index.prefix_ends[number[spot]]
    spot, tried = spot[tried > 0], tried[tried > 0]
    upto = np.concatenate([[0], np.cumsum(tried)])
    first = index.prefix_ends[number[spot]]
    starts, windows = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for low in range(0, int(upto[-1]), SLICE):
        at = np.arange(low, min(low + SLICE, upto[-1]))
        own = np.searchsorted(upto, at, side="right") - 1
        entry = first[own] + at - upto[own]
        window, word = index.prefix_window[entry], spot[own]
        start = word - index.prefix_place[entry]
        text = np.searchsorted(ends, word, side="right") - 1
        fits = (start >= ends[text]) & (start + index.length[window] <= ends[text + 1])
        start, window = start[fits], window[fits]
        for k in range(WINDOW):
            short = index.length[window] <= k
            same = short | (number[np.minimum(start + k, len(number) - 1)] == index.window[window, k])
            start, window = start[same], window[same]
        starts.append(start)
        windows.append(window)
    return np.concatenate(starts), np.concatenate(windows)


def items_of(index: Index, text: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Distinct pairs of text and item for occurrences of windows in texts."""
    pairs = np.unique(np.stack([text, window], axis=1), axis=0) if len(text) else np.zeros((0, 2), dtype=np.int64)
    size = index.item_ends[pairs[:, 1] + 1] - index.item_ends[pairs[:, 1]]
    at = np.repeat(index.item_ends[pairs[:, 1]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(pairs) else np.zeros(0, dtype=np.int64)
    owner, item = np.repeat(pairs[:, 0], size), index.item[at]
    named = np.array([n is not None for n in index.names], dtype=bool)[item] if len(item) else np.zeros(0, dtype=bool)
    return np.unique(np.stack([owner[named], item[named]], axis=1), axis=0) if named.any() else np.zeros((0, 2), dtype=np.int64)


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        seen = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                number = numbered(words(LOWER[chunk.data], chunk.ends, PLAIN).key, known)
                seen += np.bincount(number[number >= 0], minlength=len(known))
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(known[there].view(np.int64)), pa.array(seen[there])], names=["word", "n"])

    return run


def _matcher(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = block.value
        names = np.array([n if n is not None else "" for n in index.names], dtype=object)
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = words(LOWER[chunk.data], chunk.ends, PLAIN)
                number = numbered(found.key, index.vocabulary)
                start, window = occurrences(index, number, found.ends)
                text = np.searchsorted(found.ends, start, side="right") - 1
                # A text's hits as merged half-open ranges of its own word numbers.
                edge = np.zeros(len(number) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                owner_first = np.zeros(len(number), dtype=bool)
                owner_first[found.ends[:-1][found.ends[:-1] < len(number)]] = True
                before = np.concatenate([[False], hit[:-1]]) & ~owner_first if len(hit) else hit
                after = np.concatenate([hit[1:] & ~owner_first[1:], [False]]) if len(hit) else hit
                begin, stop = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
                own = np.searchsorted(found.ends, begin, side="right") - 1
                ranges = np.stack([begin - found.ends[own], stop - found.ends[own]], axis=1).astype(np.int32).reshape(-1)
                range_ends = 2 * np.searchsorted(own, np.arange(chunk.rows + 1))
                pairs = items_of(index, text, window)
                item_ends = np.searchsorted(pairs[:, 0], np.arange(chunk.rows + 1))
                rows = slice(chunk.first, chunk.first + chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows],
                        batch.column(1)[rows],
                        pa.array(np.diff(found.ends).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(range_ends, pa.int32()), pa.array(ranges)),
                        pa.ListArray.from_arrays(pa.array(item_ends, pa.int32()), pa.array(names[pairs[:, 1]].tolist(), pa.string())),
                    ],
                    names=["doc_id", "text_hash", "n_words", "ranges", "items"],
                )

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, counts, digests = [], [], []
        for ranges, items in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            reached = total = 0
            for a, b in sorted(zip(ranges[::2], ranges[1::2])):
                total += max(0, b - max(a, reached))
                reached = max(reached, b)
            hits.append(total)
            distinct = sorted(set(items))
            counts.append(len(distinct))
            digests.append(hashlib.sha256(",".join(distinct).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words, hit words and contained items of every row of ``docs``.

    Returns ``doc_id``, ``text_hash``, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("body")).filter("body <> ''").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    found = []
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("name", "body"), F.lit(blocks)) == k)
        table = own.orderBy("name", "body").toArrow()
        texts = table.column("body").combine_chunks() if table.num_rows else pa.array([], pa.string())
        keys, length, _, _ = item_windows(texts)
        vocabulary = np.unique(keys[np.arange(WINDOW)[None, :] < length[:, None]])
        known = spark.sparkContext.broadcast(vocabulary)
        counted = source.select("text").mapInArrow(_counter(known), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros(len(vocabulary), dtype=np.int64)
        if counted.num_rows:
            seen[np.searchsorted(vocabulary, counted.column("word").to_numpy().view(np.uint64))] = counted.column("n").to_numpy()
        index = spark.sparkContext.broadcast(build_index(table.column("name").to_pylist(), texts, vocabulary, seen))
        found.append(source.mapInArrow(_matcher(index), f"doc_id {kind}, text_hash long, n_words long, ranges array<int>, items array<string>"))
    rows = found[0]
    if blocks > 1:
        key = ["doc_id", "text_hash"]
        hits = [more.filter(F.size("ranges") > 0).select(*key, "ranges", "items", F.lit(k).alias("block")) for k, more in enumerate(found)]
        hit = hits[0]
        for more in hits[1:]:
            hit = hit.union(more)
        hit = hit.dropDuplicates([*key, "block"]).groupBy(*key).agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))  # a row per block at most
        hit = stage(hit.withColumnsRenamed({"doc_id": "h_id", "text_hash": "h_hash"}), "op2-blocks")
        rows = rows.select(*key, "n_words").join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
        rows = rows.select(*key, "n_words", F.coalesce("ranges", F.array().cast("array<int>")).alias("ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = rows.mapInArrow(_summary, f"doc_id {kind}, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with the columns of ``docs``."""
    hit = contamination(docs, benchmark, id_column=id_column, text=text, **options).filter("contaminated")
    hit = stage(hit.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash")).distinct(), "op2-hits")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("k_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("k_hash"))
    return packed.join(hit, F.col("k_id").eqNullSafe(F.col("h_id")) & (F.col("k_hash") == F.col("h_hash")), "left_anti").select("row.*")
