"""Conversation tries, spelling variants and vector links against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.llm import conversation_trie, embedding_duplicates, links, spelling_variants

CLASHING = {"node": 7, "part": "x", "word": 1, "rid": 2, "label": 3}


def _with_clashes(df):
    return df.withColumns({name: F.lit(value) for name, value in CLASHING.items()})


# conversations -------------------------------------------------------------


def _trie(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for own in turns.values():
        own.sort()
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = [t[2:] for t in turns.get(c - int(math.fmod(c, 20)), [])[:h]] + [t[2:] for t in own[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
        ends[tuple(own)].append(c)
    out = []
    for node, convs in members.items():
        below = [u for u in members if u[: len(node)] == node]
        children = lambda v: sum(len(u) == len(v) + 1 and u[: len(v)] == v for u in members)
        saved = sum((len(members[u]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) for u in below if u)
        listed = ",".join(map(str, sorted(ends[node])))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children(node), sum(children(u) == 0 for u in below), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def _conversations() -> list[tuple]:
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "d e f"])) for c in range(44) for t in range(rng.randint(0, 5))]
    rows += [(60, t, "user", f"turn {t}") for t in range(90)]  # a long one
    rows += [(61, None, None, "x y"), (61, None, "user", None), (61, 2, "", ""), (61, 2, "", ""), (62, 1, "user", "tie b"), (62, 1, "user", "tie a"), (62, 1, "bot", "tie"), (None, 1, "user", "lost"), (-7, 0, "user", "a b")]
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(3)]
    return rows


@pytest.mark.parametrize("block", [20, 100_000])
def test_trie_equals_brute_force(spark, block):
    rows = _conversations()
    table = _with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    got = sorted((tuple(r) for r in conversation_trie.prefix_trie(table, block=block).collect()), key=repr)
    assert got == _trie(rows)


def test_long_conversation_is_carried_over_tasks(spark):
    rows = [(3, t, "user", str(t % 7)) for t in range(3_000)] + [(5, 0, "user", "x"), (1, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = conversation_trie.turns(table)
        assert own.filter("conv = 3").select(F.spark_partition_id()).distinct().count() >= 1
        local = own.filter("conv = 3").orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in local] == list(range(1, 3_001))
    assert all((x["a"], x["b"]) == (y["was_a"], y["was_b"]) for x, y in zip(local, local[1:]))
    short = sorted((tuple(r) for r in conversation_trie.prefix_trie(table.filter("turn < 120"), block=16).collect()), key=repr)
    assert short == _trie([r for r in rows if r[1] < 120])


def test_trie_of_no_rows(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


# spelling ------------------------------------------------------------------


def _variants(rows: list[tuple]) -> dict:
    count: Counter[str] = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}

    def one(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {a: [b for b in words if one(a, b)] for a in words}
    form = {}
    for a in words:
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        if best is not None and words[best] >= 10 * words[a]:
            form[a] = best
    out = {}
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out[a] = (form.get(a), root, words[a], len(near[a]), words[form[a]] if a in form else None)
    return out


def _spelled() -> list[tuple]:
    rng = random.Random(9)
    letters = "aabé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(90)]
    long = "q" * 9 + "r" * 8
    words += ["x" * 5_000, "x" * 2_000 + "y" + "x" * 3_000]  # only their tails are compared
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", long, long + "q", "q" + long, long[:4] + "z" + long[5:], long[1:]]
    chain = ["statement"] * 400 + ["statemant"] * 30 + ["stetemant"] * 2 + ["Statement×"] * 3 + ["stat÷ement"] * 2
    rows = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(80)] + [(900 + k, f"{w}. {w}\n{w}") for k, w in enumerate(words)]
    rows += [(k + 200, " ".join(chain[k::20])) for k in range(20)]
    rows += [(None, "Nothing NOTHING nothing"), (300, None), (301, ""), (302, "123 _ -"), rows[0]]
    return rows


def test_variants_equal_brute_force(spark):
    rows = _spelled()
    table = _with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    out = spelling_variants.variants(table)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r["word"]: tuple(r)[1:] for r in out.collect()}
    assert got == _variants(rows)
    assert got["stetemant"][1] == "statement"


def test_frontier_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "FRONTIER", 5)
    rows = _spelled()[:60]
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _variants(rows)


def test_variants_of_few_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.variants(empty).isEmpty()
    lone = spark.createDataFrame([(1, "lonelyword lonelyword")], "doc_id long, text string")
    assert [tuple(r) for r in spelling_variants.variants(lone).collect()] == [(w, *v) for w, v in _variants([(1, "lonelyword lonelyword")]).items()]


# vectors -------------------------------------------------------------------


def _cosines(rows: list[tuple], least: float) -> dict:
    """Links and components of rows by comparing all pairs."""
    usable = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for i in usable:
        for j in usable:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        named = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(named, default=None)
        out.append((vec, len(near[i]), least_id, vec is not None and vec == least_id))
    return Counter(out)


def _vectors() -> list[tuple]:
    rng = np.random.default_rng(2)
    f = lambda x: np.asarray(x, np.float32).tolist()
    rows = [(k, f(rng.normal(size=12))) for k in range(300)]
    centre = rng.normal(size=12)
    rows += [(1000 + k, f(centre + rng.normal(size=12) * 0.3)) for k in range(150)]  # about the threshold
    rows += [(2000 + k, rows[3][1]) for k in range(40)] + [(3000 + k, f(np.array(rows[5][1]) * (k + 2))) for k in range(5)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, f(rng.normal(size=12)))]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 12), (4003, [*rows[0][1][:11], None]), (4004, [float("nan")] * 12), (4005, [float("inf"), *[1.0] * 11]), (4006, f(rng.normal(size=3))), (4007, rows[1][1][:5])]
    rows += [(5000, f(np.full(12, 1e-30))), (5001, f(np.full(12, 1e30))), (5002, f(-np.full(12, 1e-30)))]
    return rows


def test_links_equal_all_pairs(spark, monkeypatch):
    rows = _vectors()
    table = _with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    out = embedding_duplicates.near_vectors(table)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(tuple(r) for r in out.collect()) == _cosines(rows, 0.9)
    monkeypatch.setattr(embedding_duplicates, "UNIT", 16)
    monkeypatch.setattr(embedding_duplicates, "UNITS", 2)
    carried = embedding_duplicates.near_vectors(table, carry=["label"], least=0.5)
    assert carried.select("row.label").distinct().collect()[0][0] == 3
    assert Counter(tuple(r) for r in carried.drop("row").collect()) == _cosines(rows, 0.5)


def test_links_of_no_vectors(spark):
    assert embedding_duplicates.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    lone = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding_duplicates.near_vectors(lone).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("dim", [3, 64, 2500])
def test_bounds_hold(dim):
    """No bound is broken, and few pairs are computed again."""
    rng = np.random.default_rng(dim)
    x = embedding_duplicates.unit_length(rng.normal(size=(200, dim)) + 2 * rng.normal(size=dim))
    codes, scale, error = embedding_duplicates.coded(x)
    assert codes.dtype == np.int8 and (np.abs(codes.astype(int)) <= 127).all()
    length = np.sqrt(((codes * scale[:, None]) ** 2).sum(axis=1))
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    slack = length[:, None] * error + error[:, None]
    assert (np.abs(near - x @ x.T) <= slack + 1e-12).all()
    table = pa.table({"dim": [dim], "rid": [np.arange(200).tobytes()], "copies": [np.ones(200, np.int64).tobytes()], "codes": [codes.tobytes()], "scale": [scale.tobytes()], "error": [error.tobytes()], "unit_vector": [x.tobytes()]})
    side = embedding_duplicates._Side(table)
    found = {(int(i), int(j)) for a, b in embedding_duplicates.linked(side, side, 0.85) for i, j in zip(a, b, strict=True)}
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.85), strict=True)}


def test_components_of_hubs(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 400)] + [(500 + k, 501 + k) for k in range(120)] + [(rng.randint(700, 900), rng.randint(700, 900)) for _ in range(90)] + [(950, 950), (None, 3), (3, None)]
    label = {v: v for e in edges if None not in e for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and b is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    table = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, links.components(table).collect())) == label
    monkeypatch.setattr(links, "is_few", lambda table, most=0: False)
    monkeypatch.setattr(links, "HUB", 50)
    assert dict(map(tuple, links.components(table).collect())) == label
