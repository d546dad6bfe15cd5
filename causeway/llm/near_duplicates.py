"""Operator 10: near-duplicates by order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles.  Order MinHash labels each
shingle with its occurrence number, takes the ``PICK`` smallest labels under a
seeded hash and keeps their text order; equal sketches in any of ``TABLES``
tables make a candidate.  Candidates are aligned: two documents are similar when
the longest common subsequence of their shingles, inside the band that the
threshold allows, is at least 0.8 of what both hold together
(matched / (n + m - matched)).  Classes are the connected components.

No bucket is expanded into pairs.  Exact copies collapse first; then a fixed number
of passes follows, whatever the size of a bucket:

1. Each member of a sketch bucket meets the bucket's head.  The links give
   components.  Two members that met no head of theirs and still lie in different
   components leave their bucket open.
2. Members of open buckets are dealt by prefixes: with labelled shingles in one
   order, rare ones first, two texts that reach the threshold share a shingle among
   the first n - ceil(0.8 n) + 1 of each, and at the first shared one their places
   leave room for the overlap they need (positional bound).  Each member meets its
   bucket's head again, here the one with the earliest place: of many edited copies
   that is the least edited one, which is similar to most.
3. In buckets still open, members outside the largest component meet those of other
   components that the length and positional bounds admit.

What can be missed: a pair is compared, or lies in one component already, if it
shares a bucket of the ``TABLES`` sketches, at exactly 0.8 all but about
(1 - 0.8 ** 3) ** 10 = 0.08 % of them.  Passes 2 and 3 lose nothing.

Cases
* null, empty or wordless texts are classes of their own;
* texts under five words are one shorter shingle;
* rows with equal id and text are copies of each other;
* a null id sorts last when a class picks its ``class_id``;
* extra columns are not read by :func:`classes` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.links import components, is_few
from causeway.llm.textkit import LOWER, PLAIN, chunks, mix, shingles, words
from causeway.staging import stage

SHINGLE = 5
SIMILAR = 0.8
TABLES = 10
PICK = 3
#: Slots in which shingles are counted for the order of prefixes; any order is right, a good one parts better.
SLOTS = 1 << 18
#: Tasks over which the rows of one hot key are dealt.
SALTS = 16
#: Members of a bucket, or pairs of a head, for each task that compares them.
DEALT = 20_000
#: Row ids (8 bytes each) up to which a selection of sequences is broadcast; beyond it is shuffled.
BROADCAST_IDS = 1_000_000

_STEP = np.uint64(0xA24BAED4963EE407)


def _occurrences(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each shingle came before in its own text."""
    rank = np.zeros(len(key), dtype=np.uint64)
    tagged = mix(key + owner.astype(np.uint64) * _STEP)
    order = np.argsort(tagged)
    near = tagged[order]
    equal = near[1:] == near[:-1]
    if equal.any():
        inside = np.zeros(len(key), dtype=bool)
        inside[1:] |= equal
        inside[:-1] |= equal
        own = order[inside]
        own = own[np.lexsort((own, tagged[own]))]
        new = np.ones(len(own), dtype=bool)
        new[1:] = tagged[own[1:]] != tagged[own[:-1]]
        at = np.arange(len(own))
        rank[own] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return rank


def order_sketches(key: np.ndarray, ends: np.ndarray, tables: int, pick: int = PICK, seed: int = 0) -> np.ndarray:
    """Order MinHash keys, one row per text with shingles and one column per table."""
    count = np.diff(ends)
    full = count > 0
    starts, sizes = ends[:-1][full], count[full]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    label = mix(key + _occurrences(key, owner) * _STEP)
    out = np.empty((len(sizes), tables), dtype=np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(tables):
        value = mix(label ^ mix(np.array([seed * 1000 + t + 1], dtype=np.uint64))[0])
        picked = []
        for k in range(pick):
            least = np.minimum.reduceat(value, starts)
            where = np.flatnonzero(value == np.repeat(least, sizes))
            first = np.full(len(sizes), len(key), dtype=np.int64)
            np.minimum.at(first, owner[where], where)
            gone = sizes <= k
            first[gone] = -1
            picked.append(first)
            value[first[~gone]] = top
        ordered = np.sort(np.stack(picked), axis=0)
        code = np.full(len(sizes), np.uint64(t + 1), dtype=np.uint64)
        for row in ordered:
            code = mix(code * _STEP + np.where(row < 0, np.uint64(0), key[np.maximum(row, 0)]))
        out[:, t] = code
    return out


def _list(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
        for chunk in chunks(texts):
            found = words(LOWER[chunk.data], chunk.ends, PLAIN)
            key, ends = shingles(found, SHINGLE)
            count = np.diff(ends)
            full = count > 0
            sketch = np.zeros((0, TABLES), dtype=np.uint64)
            whole = np.zeros((chunk.rows, 2), dtype=np.uint64)
            if full.any():
                sketch = order_sketches(key, ends, TABLES)
                at = np.arange(len(key), dtype=np.uint64) - np.repeat(ends[:-1], count).astype(np.uint64)
                for k in (0, 1):
                    whole[full, k] = np.add.reduceat(mix(key + mix(at * _STEP + np.uint64(k + 7))), ends[:-1][full])
            spots = np.concatenate([[0], np.cumsum(full * TABLES)])
            rows = slice(chunk.first, chunk.first + chunk.rows)
            yield pa.RecordBatch.from_arrays(
                [
                    ids[rows],
                    hashes[rows],
                    pa.array(count.astype(np.int64)),
                    pa.array(whole[:, 0].view(np.int64)),
                    pa.array(whole[:, 1].view(np.int64)),
                    _list(sketch.reshape(-1).view(np.int64), spots, pa.int64()),
                    _list((key >> np.uint64(32)).astype(np.uint32).view(np.int32), ends, pa.int32()),
                ],
                names=["doc_id", "text_hash", "n", "whole_a", "whole_b", "keys", "shingles"],
            )


_SKETCHED = "doc_id {id}, text_hash long, n long, whole_a long, whole_b long, keys array<long>, shingles array<int>"


def matched_in_band(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of ``a`` and ``b`` with all matches within ``band`` of the diagonal.

    Bit-parallel dynamic programming: one big integer holds a row of the table.
    """
    n, m = len(a), len(b)
    head = 0
    most = min(n, m)
    differs = np.flatnonzero(a[:most] != b[:most])
    head = int(differs[0]) if len(differs) else most
    a, b = a[head:], b[head:]
    most = min(len(a), len(b))
    tail = 0
    if most:
        differs = np.flatnonzero(a[len(a) - most :][::-1] != b[len(b) - most :][::-1])
        tail = int(differs[0]) if len(differs) else most
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    shared = np.isin(a, b)
    where: dict[int, int] = {}
    for i in np.flatnonzero(shared).tolist():
        x = int(a[i])
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = full
    for j in np.flatnonzero(np.isin(b, a)).tolist():
        hits = where[int(b[j])]
        shift = j - band
        hits &= window << shift if shift >= 0 else window >> -shift
        if hits:
            step = row & hits
            row = ((row + step) | (row - step)) & full
    return head + tail + len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILAR) -> bool:
    """Whether the banded alignment of two shingle sequences reaches ``threshold``."""
    both = len(a) + len(b)
    need = int(np.ceil(threshold / (1 + threshold) * both - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[ia], cb[ib]).sum()) < need:
        return False
    return matched_in_band(a, b, both - 2 * need) >= need


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        la, lb = left.offsets.to_numpy(), right.offsets.to_numpy()
        va, vb = left.values.to_numpy(), right.values.to_numpy()
        good = np.fromiter((similar(va[la[i] : la[i + 1]], vb[lb[i] : lb[i + 1]]) for i in range(batch.num_rows)), dtype=bool, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts as hashes, and their n + 1 offsets from 0."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    key = mix(lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint32).astype(np.uint64) + np.uint64(1))
    return key, ends - ends[0]


def _slot(key: np.ndarray) -> np.ndarray:
    return (key % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        counts += np.bincount(_slot(_flat(batch.column(0))[0]), minlength=SLOTS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Shingles of a text of ``n`` among which each similar text has one, in any common order."""
    return n - np.ceil(SIMILAR * n - 1e-9).astype(np.int64) + 1


def _prefixes(sent):
    """Bucket keys of the rarest labelled shingles of each text, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            key, ends = _flat(batch.column(3))
            size = np.diff(ends)
            owner = np.repeat(np.arange(len(size)), size)
            label = mix(key + _occurrences(key, owner) * _STEP)
            order = np.lexsort((label, counts[_slot(key)], owner))
            first = np.arange(len(key)) - np.repeat(ends[:-1], size) < np.repeat(prefix_length(size), size)
            keys = _list(label[order][first].view(np.int64), np.concatenate([[0], np.cumsum(prefix_length(size))]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), keys], names=["rid", "n", "label", "keys"])

    return run


def _dealt_by_prefix(rows: DataFrame) -> DataFrame:
    """Members of prefix buckets for ``rows(rid, n, label, shingles)``; similar ones always share a bucket."""
    counted = rows.select("shingles").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(counts)
    keys = rows.select("rid", "n", "label", "shingles").mapInArrow(_prefixes(sent), "rid long, n long, label long, keys array<long>")
    return keys.select("rid", "n", "label", F.posexplode("keys").alias("at", "bucket")).withColumn("rank", F.col("at") / F.col("n"))


def _salted(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join ``few``, unique by ``on``, with a hot key of ``rows`` dealt over ``SALTS`` tasks."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(few, [*on, "salt"], how).drop("salt")


def _part(parts: Column) -> Column:
    """Task among ``parts`` of a row, by its id."""
    return F.pmod(F.xxhash64("rid"), parts).cast("int")


def _copies(parts: Column) -> Column:
    """A copy for each of ``parts`` tasks."""
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _labelled(rows: DataFrame, labels: DataFrame, vertex: str, name: str) -> DataFrame:
    """``rows`` with the component of ``vertex`` as ``name``; a vertex without links is its own."""
    own = labels.select(F.col("v").alias("own_v"), F.col("label").alias("own_label"))
    return rows.join(own, F.col(vertex) == F.col("own_v"), "left").withColumn(name, F.coalesce("own_label", vertex)).drop("own_v", "own_label")


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Components of the links so far and the ``found`` ones."""
    if found.isEmpty():
        return labels
    between = _labelled(_labelled(found, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b")
    joined = components(between, "op10-components")
    fresh = joined.select(F.col("v").alias("old"), F.col("label").alias("new"))
    known = labels.join(fresh, F.col("label") == F.col("old"), "left").select("v", F.coalesce("new", "label").alias("label"))
    return stage(known.union(joined.join(labels.select("v"), "v", "left_anti")), "op10-components")


def _only(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` with the given ids, which are broadcast while they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return table.join(F.broadcast(ids) if few else ids, "rid")


def _linked(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Similar ones of ``pairs(head, rid)`` as staged ``(a, b)``.

    A row's own sequence joins first; the pairs of a hot head are then dealt over as
    many tasks as they fill, each with a copy of the head's sequence.
    """
    pairs = stage(pairs.distinct(), "op10-pairs")
    hot = pairs.groupBy("head").agg(F.count("*").alias("met")).filter(F.col("met") > DEALT).select("head", F.ceil(F.col("met") / DEALT).cast("int").alias("parts"))
    hot = stage(hot, "op10-hot")
    hot = F.broadcast(hot) if is_few(hot) else hot
    own = _only(table, pairs.select("rid").union(pairs.select("head")).distinct()).select("rid", "shingles")
    left = own.select("rid", F.col("shingles").alias("sa"))
    right = own.select(F.col("rid").alias("head"), F.col("shingles").alias("sb")).join(hot, "head", "left").withColumn("part", _copies(F.coalesce("parts", F.lit(1)))).drop("parts")
    dealt = pairs.join(hot, "head", "left").withColumn("part", _part(F.coalesce("parts", F.lit(1)))).drop("parts")
    joined = dealt.join(left, "rid").join(right, ["head", "part"]).select(F.least("rid", "head").alias("a"), F.greatest("rid", "head").alias("b"), "sa", "sb")
    return stage(joined.mapInArrow(_verified, "a long, b long").distinct(), "op10-links")


def _admitted(n: str, at: str, m: str, m_at: str) -> Column:
    """Whether two texts that share the shingles at these places first can overlap enough."""
    need = F.ceil(SIMILAR / (1 + SIMILAR) * (F.col(n) + F.col(m)) - 1e-9)
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(m_at)) >= need


def _meet_heads(members: DataFrame, table: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare each of ``members(bucket, rid, n, at, rank, label)`` with the head of its bucket.

    Returns the new components and the members other than heads of buckets in
    which these lie in several components.
    """
    heads = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rank", F.col("rid").alias("head"), F.col("n").alias("head_n"), F.col("at").alias("head_at"), F.col("label").alias("head_label"))).alias("best"))
    heads = heads.filter("size > 1").select("bucket", "best.head", "best.head_n", "best.head_at", "best.head_label")
    met = stage(_salted(members, heads, ["bucket"], "inner").drop("rank"), "op10-met")
    fits = (F.col("label") != F.col("head_label")) & _admitted("n", "at", "head_n", "head_at")
    labels = _merged(labels, _linked(met.filter(fits).select("head", "rid"), table))
    left = stage(_labelled(met.filter("rid <> head").select("bucket", "rid", "n", "at"), labels, "rid", "label"), "op10-left")
    parted = left.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    return labels, stage(_salted(left, parted, ["bucket"], "inner"), "op10-open")


def _meet_others(members: DataFrame) -> DataFrame:
    """Pairs of ``members(bucket, rid, n, at, label)`` in different components that the bounds admit.

    A bucket of more than ``DEALT`` members is dealt over as many tasks as it fills,
    each with all of its members outside the largest component.
    """
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label"))["label"].alias("largest"), F.ceil(F.sum("size") / DEALT).cast("int").alias("parts"))
    told = stage(_salted(members, largest, ["bucket"], "inner"), "op10-told")
    few = told.filter("label <> largest").select("bucket", _copies(F.col("parts")).alias("part"), F.col("rid").alias("head"), F.col("n").alias("head_n"), F.col("at").alias("head_at"), F.col("label").alias("head_label"))
    once = (F.col("label") == F.col("largest")) | (F.col("rid") < F.col("head"))
    met = told.withColumn("part", _part(F.col("parts"))).join(few, ["bucket", "part"]).filter((F.col("label") != F.col("head_label")) & once & _admitted("n", "at", "head_n", "head_at"))
    return met.select("head", "rid")


def _links(reps: DataFrame, table: DataFrame) -> DataFrame:
    """Components of the verified links between different texts, as staged ``(v, label)``."""
    none = stage(reps.filter("false").select(F.col("rid").alias("v"), F.col("rid").alias("label")), "op10-none")
    members = reps.select("rid", "n", F.col("rid").alias("label"), F.explode("keys").alias("bucket")).withColumns({"at": F.lit(0), "rank": F.xxhash64("rid").cast("double")})
    labels, left = _meet_heads(members, table, none)
    if left.isEmpty():
        return labels
    again = stage(_only(table.select("rid", "n", "shingles"), left.select("rid", "label").distinct()), "op10-again")
    labels, left = _meet_heads(_dealt_by_prefix(again), table, labels)
    return labels if left.isEmpty() else _merged(labels, _linked(_meet_others(left), table))


def classes(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate class of every row.

    Returns ``doc_id``, ``text_hash`` (xxhash64 of the text), ``class_id`` (the
    least id of the class), ``class_size`` and ``first``, true for the one row
    that stands for its class.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), _text_hash(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    table = stage(source.mapInArrow(_sketched, _SKETCHED.format(id=kind)).withColumn("rid", F.monotonically_increasing_id()), "op10-sketches")
    copies = table.filter("n > 0").groupBy("whole_a", "whole_b").agg(F.min("rid").alias("rep"), F.count("*").alias("size")).filter("size > 1").drop("size")
    narrow = table.select("rid", "doc_id", "text_hash", "n", "whole_a", "whole_b", "keys")
    rows = _salted(narrow, copies, ["whole_a", "whole_b"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "rid")).otherwise(F.col("rid")))
    rows = stage(rows.select("rid", "doc_id", "text_hash", "n", "rep", F.when(F.col("rid") == F.col("rep"), F.col("keys")).alias("keys")), "op10-rows")
    labels = _links(rows.filter("rid = rep and n > 0").select("rid", "n", "keys"), table)
    rows = _labelled(rows.select("rid", "doc_id", "text_hash", "rep"), labels, "rep", "label").select("rid", "doc_id", "text_hash", "label")
    rows = stage(rows, "op10-labelled")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("rid").alias("head"))
    groups = rows.groupBy("label").agg(F.min(order).alias("least"), F.count("*").alias("size")).filter("size > 1")
    groups = stage(groups.select("label", F.col("least.doc_id").alias("least_id"), "least.head", "size"), "op10-groups")
    out = _salted(rows, groups, ["label"], "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        (F.coalesce("head", "rid") == F.col("rid")).alias("first"),
    )


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def drop_copies(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with the columns of ``docs``.

    Rows with equal id and text count as copies even where the text has no word.
    """
    firsts = stage(classes(docs, id_column=id_column, text=text).filter("first").select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash")).distinct(), "op10-firsts")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("k_id"), _text_hash(F.col(text)).alias("k_hash"))
    repeated = not packed.groupBy("k_id", "k_hash").count().filter("count > 1").isEmpty()
    kept = packed.join(firsts, F.col("k_id").eqNullSafe(F.col("f_id")) & (F.col("k_hash") == F.col("f_hash")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["k_id", "k_hash"])
    return kept.select("row.*")
