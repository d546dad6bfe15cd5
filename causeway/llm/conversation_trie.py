"""Operator 11: a prefix trie of conversations, rolled up by centroid decomposition.

``turns`` orders the turns of each conversation and numbers every prefix by a
polynomial over the digests of its turns, a number that can be carried from one
task to the next: a conversation of any length is dealt over tasks.  ``rebuilt``
puts the opening turns of one conversation before another.  ``nodes`` groups equal
prefixes: the trie, as a forest of edges to the parent.

``rollup`` sums values over the subtrees of such a forest.  The *mass* of a node is
the number of (conversation, prefix) rows in its subtree, known from the grouping.
In a component the nodes that hold at least half of the mass form a path from the
top to the centroid, so no path is walked.  The total of the centroid's subtree is
added to all nodes of that path; then the component falls apart into the children
of the centroid and the part above it, each with at most half of the mass.  Large
components are split by joins, a round for all of them at once; which side a node
falls on is looked up in the prefixes of a conversation that passes through it.
Components of at most ``BLOCK`` rows are finished in one task each, by the same steps.

Cases
-----
* Turns are ordered by ``turn`` (null first), then role, then text; repeated rows are
  turns of their own.  A null role or text counts as empty.
* Rows without a conversation id belong to no conversation and are left out.
* Ids are integers; c % 20 of a negative one is negative or 0, as in SQL.  Texts are hashed and counted whole and not carried further.
* No rows give no nodes, not even a root.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.links import is_few, salted
from causeway.staging import stage

#: Conversations of a block share the opening of its first one; an opening has fewer turns than ``OPENINGS``.
FAMILY, OPENINGS = 20, 4
#: Rows of a component that one task finishes.
BLOCK = 4096
#: Ids that are joined into one piece of a list.
PIECE = 4096
_PRIME = (1 << 61) - 1
_BASES = (0x1A2B3C4D5E6F7081, 0x0FEDCBA987654321)
_BACK = tuple(pow(b, -1, _PRIME) for b in _BASES)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank and prefix number of ordered ``(conv, digest, words)``, counted inside the task."""
    part = TaskContext.get().partitionId()
    conv, rank, a, b, pa_, pb = None, 0, 0, 0, 1, 1
    for batch in batches:
        out: list[tuple] = []
        for c, digest, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if c != conv:
                conv, rank, a, b, pa_, pb = c, 0, 0, 0, 1, 1
            rank += 1
            pa_, pb = pa_ * _BASES[0] % _PRIME, pb * _BASES[1] % _PRIME
            was_a, was_b = a, b
            a = (a + int(digest[:15], 16) * pa_) % _PRIME
            b = (b + int(digest[15:30], 16) * pb) % _PRIME
            out.append((c, part, rank, was_a, was_b, a, b, words))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 8, names=_RUNNING)


_RUNNING = ["conv", "part", "rank", "was_a", "was_b", "a", "b", "words"]


def _carried(carry: dict[int, tuple[int, int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add what earlier tasks hold of the conversation that a task begins with."""
    powers = {part: (pow(_BASES[0], n, _PRIME), pow(_BASES[1], n, _PRIME)) for part, (_, n, _, _) in carry.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True))
            for k, (c, part, rank, was_a, was_b, a, b, words) in enumerate(rows):
                if part in carry and carry[part][0] == c:
                    _, n, x, y = carry[part]
                    p, q = powers[part]
                    rows[k] = (c, part, rank + n, (x + was_a * p) % _PRIME, (y + was_b * q) % _PRIME, (x + a * p) % _PRIME, (y + b * q) % _PRIME, words)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 8, names=_RUNNING)

    return run


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0))


def turns(rows: DataFrame) -> DataFrame:
    """Ordered turns of ``rows(conv_id, turn, role, text)`` as staged ``(conv, rank, was_a, was_b, a, b, words)``.

    ``a`` and ``b`` number the prefix that ends with the turn, ``was_a`` and ``was_b``
    the one before it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    own = own.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    told = own.select("conv", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"), word_count(F.col("text")).alias("words"))
    kind = ", ".join(f"{c} long" for c in _RUNNING)
    local = stage(told.mapInArrow(_running, kind), "op11-local")
    # at most one row a task
    ends = local.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max(F.struct("conv", "rank", "a", "b")).alias("end")).orderBy("part").collect()
    carry: dict[int, tuple[int, int, int, int]] = {}
    held: tuple[int, int, int, int] | None = None
    for row in ends:
        conv, n, a, b = row["end"]["conv"], row["end"]["rank"], row["end"]["a"], row["end"]["b"]
        if held is not None and held[0] == row["first"]:
            carry[row["part"]] = held
            if conv == row["first"]:
                n, a, b = held[1] + n, (held[2] + a * pow(_BASES[0], held[1], _PRIME)) % _PRIME, (held[3] + b * pow(_BASES[1], held[1], _PRIME)) % _PRIME
        held = (conv, n, a, b)
    return local.mapInArrow(_carried(carry), kind).drop("part") if carry else local.drop("part")


def _node(a: Column | str, b: Column | str) -> Column:
    """Prefix numbers as text."""
    return F.concat(*[F.lpad(F.hex(F.col(c) if isinstance(c, str) else c), 16, "0") for c in (a, b)])


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix numbers of own turns behind another opening."""
    for batch in batches:
        out = []
        for conv, rank, was_a, was_b, a, b, words, cut, taken, open_a, open_b, own_a, own_b in zip(*(batch.column(k).to_pylist() for k in range(13)), strict=True):
            p, q = pow(_BACK[0], cut - taken, _PRIME), pow(_BACK[1], cut - taken, _PRIME)
            here = [(open_a + (v - own_a) * p) % _PRIME for v in (was_a, a)], [(open_b + (v - own_b) * q) % _PRIME for v in (was_b, b)]
            out.append((conv, rank - cut + taken, here[0][0], here[1][0], here[0][1], here[1][1], words))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=["conv", "depth", "was_a", "was_b", "a", "b", "words"])


def rebuilt(rows: DataFrame) -> DataFrame:
    """Prefixes of rebuilt conversations as staged ``(conv, depth, node, parent, words, size)``.

    Conversation c takes the first h turns of conversation c - c % ``FAMILY`` (h is the
    CRC-32 of c's decimals modulo ``OPENINGS``), then its own turns after its first h.
    ``depth`` 0 is the empty prefix; ``words`` counts the last turn's text, ``size``
    the turns of the whole conversation.
    """
    own = stage(turns(rows), "op11-turns")
    first = [F.max(F.when(F.col("rank") == k, F.struct("a", "b", "words"))).alias(f"t{k}") for k in range(1, OPENINGS)]
    convs = stage(own.groupBy("conv").agg(F.max("rank").alias("n"), *first), "op11-conversations")
    opening = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(OPENINGS))
    blank = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("words"))
    heads = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.array(blank, *[F.coalesce(f"t{k}", blank) for k in range(1, OPENINGS)]).alias("opening"))
    heads = convs.withColumn("h", opening).withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(heads, "base", "left")  # at most FAMILY conversations a base
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    own_at = F.array(blank, *[F.coalesce(f"t{k}", blank) for k in range(1, OPENINGS)])[F.least("h", "n").cast("int")]
    plan = heads.select(
        "conv",
        F.col("h").alias("cut"),
        taken.alias("taken"),
        (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"),
        F.coalesce("opening", F.array(blank)).alias("opening"),
        own_at.alias("own"),
    )
    plan = stage(plan, "op11-plan")
    started = plan.select("conv", "size", F.posexplode(F.slice("opening", 1, (F.col("taken") + 1).cast("int"))).alias("depth", "t"), "opening")
    before = F.col("opening")[F.greatest(F.col("depth") - 1, F.lit(0))]
    started = started.select("conv", F.col("depth").cast("long").alias("depth"), _node("t.a", "t.b").alias("node"), F.when(F.col("depth") > 0, _node(before["a"], before["b"])).alias("parent"), "t.words", "size")
    at = F.col("opening")[F.col("taken").cast("int")]
    needed = plan.select("conv", "cut", "taken", at["a"].alias("open_a"), at["b"].alias("open_b"), F.col("own.a").alias("own_a"), F.col("own.b").alias("own_b"))
    joined = own.join(needed, "conv").filter("rank > cut")
    joined = joined.select("conv", "rank", "was_a", "was_b", "a", "b", "words", "cut", "taken", "open_a", "open_b", "own_a", "own_b")
    moved = joined.mapInArrow(_spliced, "conv long, depth long, was_a long, was_b long, a long, b long, words long")
    moved = moved.select("conv", "depth", _node("a", "b").alias("node"), _node("was_a", "was_b").alias("parent"), "words").join(plan.select("conv", "size"), "conv")
    return stage(started.unionByName(moved), "op11-prefixes")


def nodes(prefixes: DataFrame) -> DataFrame:
    """The trie of ``prefixes`` as a staged forest.

    Per node: ``conv`` (least member), ``depth``, ``parent``, ``words``, ``n_convs``,
    ``n_ends`` and ``first_end`` (members that end here), ``mass`` (rows of its
    subtree) and ``n_children``.
    """
    ends = F.col("depth") == F.col("size")
    grouped = prefixes.groupBy("node").agg(
        F.min("conv").alias("conv"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.max("words").alias("words"),
        F.count("*").alias("n_convs"),
        F.count_if(ends).alias("n_ends"),
        F.min(F.when(ends, F.col("conv"))).alias("first_end"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("mass"),
    )
    grouped = stage(grouped, "op11-grouped")
    children = grouped.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return stage(grouped.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "op11-nodes")


def _finished(values: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Split whole components until each node stands alone; rows come ordered by component and depth."""
    names = ["node", *values]

    def solve(rows: list[tuple]) -> list[tuple]:
        place = {row[1]: k for k, row in enumerate(rows)}
        parent = [place.get(row[2], -1) for row in rows]
        mass = [row[3] for row in rows]
        own = [row[4] for row in rows]
        total = [list(row[5]) for row in rows]
        work = [list(range(len(rows)))]
        while work:
            part = work.pop()
            inside = set(part)
            half = mass[part[0]]
            path = [v for v in part if 2 * mass[v] >= half]
            centre = min(path, key=lambda v: mass[v])
            child: dict[int, int] = {}
            below: dict[int, list[int]] = {}
            above: list[int] = []
            gained = list(own[centre])
            for v in part:  # parents come first
                up = parent[v] if parent[v] in inside else -1
                if v == centre:
                    continue
                top = v if up == centre else child.get(up)
                if top is None:
                    above.append(v)
                    continue
                child[v] = top
                below.setdefault(top, []).append(v)
                for k, x in enumerate(own[v]):
                    gained[k] += x
            for v in path:
                for k, x in enumerate(gained):
                    total[v][k] += x
                if v != centre:
                    mass[v] -= mass[centre]
            work += [*below.values(), *([above] if above else [])]
        return [(rows[k][1], *total[k]) for k in range(len(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == 0 else pa.int64()) for k, v in enumerate(zip(*out, strict=True))], names=names)

        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(4 + 2 * len(values))]
            n = len(values)
            for row in zip(*columns, strict=True):
                if held and held[0][0] != row[0]:
                    out += solve(held)
                    held = []
                held.append((*row[:4], row[4 : 4 + n], row[4 + n :]))
            if out:
                yield sent(out)
        if held:
            yield sent(solve(held))

    return run


def _split(state: DataFrame, lineage: DataFrame, values: list[str]) -> DataFrame:
    """One round: every component of ``state`` falls apart at its centroid."""
    path = state.filter(F.col("mass") * 2 >= F.col("whole"))
    centres = path.groupBy("part").agg(F.min(F.struct("mass", "node", "depth")).alias("c"))
    centres = stage(centres.select("part", F.col("c.node").alias("centre"), F.col("c.mass").alias("centre_mass"), F.col("c.depth").alias("centre_depth")), "op11-centres")
    told = state.join(F.broadcast(centres), "part") if is_few(centres) else salted(state, centres, ["part"], "node", "inner")
    told = stage(told, "op11-told")
    # a node is below the centroid if a conversation through it has the centroid at that depth
    asked = told.filter("depth > centre_depth").select("part", "conv", "centre", "centre_depth").distinct()
    here = lineage.select("conv", F.col("depth").alias("centre_depth"), F.col("node").alias("centre"))
    child = lineage.select("conv", (F.col("depth") - 1).alias("centre_depth"), F.col("node").alias("child"))
    under = stage(asked.join(here, ["conv", "centre_depth", "centre"]).join(child, ["conv", "centre_depth"]).select("part", "conv", "child"), "op11-under")
    told = told.join(under, ["part", "conv"], "left")
    at = F.col("node") == F.col("centre")
    below = F.col("child").isNotNull() & (F.col("depth") > F.col("centre_depth"))
    told = stage(told.withColumns({"at": at, "below": below}), "op11-sides")
    gained = told.filter("at or below").groupBy("part").agg(*[F.sum(f"own_{v}").alias(f"gain_{v}") for v in values])
    gained = stage(gained, "op11-gains")
    told = told.join(F.broadcast(gained), "part") if is_few(gained) else salted(told, gained, ["part"], "node", "inner")
    on_path = F.col("mass") * 2 >= F.col("whole")
    for v in values:
        told = told.withColumn(f"sum_{v}", F.col(f"sum_{v}") + F.when(on_path, F.col(f"gain_{v}")).otherwise(F.lit(0)))
    mass = F.when(on_path & ~F.col("at"), F.col("mass") - F.col("centre_mass")).otherwise(F.col("mass"))
    told = told.withColumns({"part": F.when(F.col("below"), F.col("child")).otherwise(F.col("part")), "mass": mass, "done": F.col("at")})
    told = stage(told.select("part", "node", "parent", "conv", "depth", "mass", "done", *[f"{k}_{v}" for k in ("own", "sum") for v in values]), "op11-split")
    tops = told.filter("not done").groupBy("part").agg(F.max("mass").alias("whole"))
    tops = stage(tops, "op11-tops")
    alive = told.filter("not done")
    alive = alive.join(F.broadcast(tops), "part") if is_few(tops) else salted(alive, tops, ["part"], "node", "inner")
    return told.filter("done").withColumn("whole", F.lit(0).cast("long")).unionByName(alive)


def rollup(forest: DataFrame, lineage: DataFrame, values: list[str], *, block: int = BLOCK) -> DataFrame:
    """Sums of integer ``values`` over the subtree of every node, as ``(node, <values>)``.

    ``forest(node, parent, conv, depth, mass, <values>)`` has for each node a
    conversation through it and a positive mass, more than that of its children
    together; ``lineage(conv, depth, node)`` has the prefixes of these conversations.
    """
    own = [F.col(v).cast("long").alias(f"own_{v}") for v in values]
    tops = forest.filter("parent is null").select(F.col("node").alias("part"), F.col("mass").alias("whole"))
    top_of = lineage.filter("depth = 0").select("conv", F.col("node").alias("part"))
    state = forest.select("node", "parent", "conv", "depth", "mass", *own, *[F.lit(0).cast("long").alias(f"sum_{v}") for v in values])
    state = state.join(top_of, "conv")
    state = state.join(F.broadcast(tops), "part") if is_few(tops) else state.join(tops, "part")
    alive = stage(state, "op11-forest")
    named = [F.col(f"sum_{v}").alias(v) for v in values]
    done: list[DataFrame] = []
    while True:
        small = alive.filter(F.col("whole") <= block).select("part", "node", "parent", "mass", *[f"{k}_{v}" for k in ("own", "sum") for v in values], "depth")
        ordered = small.repartition("part").sortWithinPartitions("part", "depth").drop("depth")
        done.append(ordered.mapInArrow(_finished(values), "node string, " + ", ".join(f"{v} long" for v in values)))
        alive = alive.filter(F.col("whole") > block)
        if alive.isEmpty():
            break
        split = stage(_split(alive.drop("done"), lineage, values), "op11-round")
        done.append(split.filter("done").select("node", *named))
        alive = split.filter("not done").drop("done")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stage(out, "op11-sums")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join ordered ids of a node into pieces of at most ``PIECE`` ids."""
    node, ids, first = None, [], 0
    for batch in batches:
        out: list[tuple[str, int, str]] = []
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (n != node or len(ids) == PIECE):
                out.append((node, first, ",".join(ids)))
                ids = []
            if not ids:
                node, first = n, c
            ids.append(str(c))
        if out:
            yield _as_batch(out, ["node", "first", "piece"])
    if ids:
        yield _as_batch([(node, first, ",".join(ids))], ["node", "first", "piece"])


def _as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ordered pieces of each node, which are read one after the other."""
    node, state = None, None
    for batch in batches:
        out: list[tuple[str, str]] = []
        for n, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if out:
            yield _as_batch(out, ["node", "ends_sha256"])
    if node is not None:
        yield _as_batch([(node, state.hexdigest())], ["node", "ends_sha256"])


def end_digests(prefixes: DataFrame, forest: DataFrame) -> DataFrame:
    """SHA-256 of the ids of members that end at a node, for nodes where several do.

    Ids are ordered over all tasks and joined in pieces there; only the digest of one
    node, which no two tasks can share, is taken in one task, piece by piece.
    """
    several = forest.filter("n_ends > 1").select("node")
    ends = prefixes.filter("depth = size").select("node", "conv")
    ends = ends.join(F.broadcast(several), "node", "left_semi") if is_few(several) else ends.join(several, "node", "left_semi")
    pieces = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_pieces, "node string, first long, piece string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node string, ends_sha256 string")


def prefix_trie(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Every node of the trie of rebuilt conversations with its rollups.

    Returns ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (words of the last turn for each
    member but one, over the subtree) and ``ends_sha256`` (of the ids of members that
    end here).
    """
    prefixes = rebuilt(rows)
    forest = nodes(prefixes)
    valued = forest.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    sums = rollup(valued.select("node", "parent", "conv", "depth", "mass", "n_leaves", "saved_tokens"), prefixes.select("conv", "depth", "node"), ["n_leaves", "saved_tokens"], block=block)
    digests = end_digests(prefixes, forest)
    above = forest.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = forest.join(sums, "node").join(digests, "node", "left").join(above, "parent", "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.coalesce(F.col("first_end").cast("string"), F.lit("")), 256))
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))
