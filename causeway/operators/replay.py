"""Replay: where two versions of a table differ, found by hash trees.

Rows are dealt by a hash of their key to the leaves of a tree with 64 children a node;
a node has the number of rows below it and two sums of row hashes.  The comparison starts
at the roots and goes down only where digests differ, so rows are read again, and
shuffled, only for leaves that differ.  A tree is a small table (a row for about
``LEAF_ROWS`` rows) that may be kept beside the version it describes.

NaN equals NaN, NULL equals NULL only, -0.0 equals 0.0.  Repeated rows count.  Names and
types of columns must agree, their order need not; columns of maps are not supported.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.contracts import ContractError
from causeway.staging import stage

#: Rows of a leaf aimed at, bits of a child's number, and most levels of a tree.
LEAF_ROWS, FAN_BITS, DEEPEST = 1_024, 6, 8
#: Nodes up to which a list of them is broadcast (8 bytes each).
BROADCAST_NODES = 200_000


def _hash(seed: int, names: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[c for n in names for c in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))])


def check_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Raise ``ContractError`` unless both tables have the same names and types, and the keys."""
    a, b = ({f.name: f.dataType.simpleString() for f in t.schema.fields} for t in (left, right))
    if len(a) != len(left.columns) or len(b) != len(right.columns):
        raise ContractError("a table has two columns of one name")
    wrong = sorted(n for n in a.keys() | b.keys() if a.get(n) != b.get(n))
    if wrong:
        raise ContractError("columns differ: " + ", ".join(f"{n} is {a.get(n, 'absent')} and {b.get(n, 'absent')}" for n in wrong))
    lost = [k for k in keys if k not in a]
    if lost or not keys:
        raise ContractError(f"no key column {', '.join(lost)}".strip())


def depth_for(rows: int) -> int:
    """Levels below the root for leaves of about ``LEAF_ROWS`` rows."""
    return min(DEEPEST, max(1, ceil(log2(max(rows, 1) / LEAF_ROWS) / FAN_BITS))) if rows > LEAF_ROWS else 1


def _leaf(keys: list[str], depth: int) -> Column:
    return F.shiftrightunsigned(_hash(17, keys), 64 - FAN_BITS * depth)


def hash_tree(rows: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Tree of a table as ``(level, node, rows, digest_a, digest_b)``, written to the shared folder; level 0 is the root.

    The table is read once; sums are taken before the shuffle, and upper levels come from the leaves.
    """
    names = sorted(rows.columns)
    sums = [F.sum(_hash(seed, names).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"digest_{n}") for n, seed in (("a", 29), ("b", 31))]
    leaves = rows.groupBy(_leaf(keys, depth).alias("leaf")).agg(F.count("*").alias("rows"), *sums)
    lifted = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    node = F.expr(f"shiftrightunsigned(leaf, {FAN_BITS} * ({depth} - level))")
    total = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("digest_a", "digest_b")]
    return stage(lifted.groupBy("level", node.alias("node")).agg(F.sum("rows").alias("rows"), *total), "hash-tree")


def _among(rows: DataFrame, nodes: DataFrame, on: Column) -> DataFrame:
    """Rows whose node is listed; a short list is broadcast, a long one joined by a shuffle."""
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    listed = nodes.select(F.col("node").alias("listed_node"))
    return rows.join(F.broadcast(listed) if few else listed, on == F.col("listed_node"), "left_semi")


def differing_leaves(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """Leaves ``(node)`` whose digests differ between two trees of one depth."""
    near: DataFrame | None = None
    for level in range(depth + 1):
        sides = [t.filter(F.col("level") == level).drop("level") for t in (a, b)]
        if near is not None:
            sides = [_among(s, near, F.shiftrightunsigned("node", FAN_BITS)) for s in sides]
        x, y = (s.select("node", F.struct("rows", "digest_a", "digest_b").alias(n)) for s, n in zip(sides, ("x", "y")))
        near = stage(x.join(y, "node", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "replay-nodes")
        if near.isEmpty():
            break
    return near


def differences(left: DataFrame, right: DataFrame, keys: list[str], *, depth: int | None = None, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Keys whose rows differ: the keys, ``n_left``, ``n_right`` and ``changed``.

    ``n_left`` and ``n_right`` count the rows that the other side lacks.  ``changed``
    lists the columns that differ where it is one row for one row, else it is null.
    ``trees`` are trees kept from before, of the same ``depth``.
    """
    check_columns(left, right, keys)
    right = right.select(*[F.col(f"`{c}`") for c in left.columns])
    if trees is not None and depth is None:
        raise ValueError("trees need their depth")
    depth = depth or depth_for(max(left.count(), right.count()))
    a, b = trees or (hash_tree(left, keys, depth), hash_tree(right, keys, depth))
    leaves = differing_leaves(a, b, depth)
    names = {c: f"c{k}" for k, c in enumerate(left.columns)}
    sides = [_among(t, leaves, _leaf(keys, depth)).select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.lit(sign).alias("sign")) for t, sign in ((left, 1), (right, -1))]
    net = sides[0].union(sides[1]).groupBy(*names.values()).agg(F.sum("sign").alias("copies")).filter("copies <> 0")
    values = {c: n for c, n in names.items() if c not in keys}
    row = F.struct(*[F.col(n) for n in values.values()]) if values else F.struct(F.lit(0).alias("none"))
    found = net.groupBy(*[names[k] for k in keys]).agg(
        F.sum(F.greatest("copies", F.lit(0))).alias("n_left"),
        F.sum(F.greatest(-F.col("copies"), F.lit(0))).alias("n_right"),
        F.max(F.when(F.col("copies") > 0, row)).alias("l"),
        F.max(F.when(F.col("copies") < 0, row)).alias("r"),
    )
    moved = [F.when(~F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")), F.lit(c)) for c, n in sorted(values.items())]
    changed = F.array_compact(F.array(*moved)) if moved else F.array().cast("array<string>")
    return found.select(*[F.col(names[k]).alias(k) for k in keys], "n_left", "n_right", F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), changed).alias("changed"))
