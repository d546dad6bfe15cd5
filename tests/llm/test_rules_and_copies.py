"""Quality rules, near-duplicates and decontamination: edge cases and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.llm import decontamination, near_duplicates, quality_rules

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _text(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "ko", "ti", "ra", "né", "sun"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def mixed(spark):
    """Clean, junk, null, empty, repeated and very long texts, with columns that clash with inner names."""
    rng = random.Random(3)
    rows = [(k, _text(rng, rng.randint(60, 200)), "en", "s1", "x") for k in range(90)]
    rows += [(100 + k, " ".join(w + "$$$" for w in _text(rng, 80).split()), "en", "s1", "x") for k in range(3)]
    rows += [(200, None, "en", "s1", "x"), (201, "", None, None, None), (None, _text(rng, 70), None, "s9", "x"), (203, "same words here again " * 40, "en", "s1", "x")]
    rows += [rows[0], (204, _text(rng, 60_000), "en", "s1", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, stats string").withColumn("kept", F.lit(1)).withColumn("row", F.lit(2))


def _base(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, mixed):
    found = quality_rules.quality_verdicts(mixed).select("row.doc_id", "row.text", "stats.*", "base_failed", F.col("row.stats").alias("theirs"), F.expr("kept")).collect()
    assert len(found) == mixed.count()
    for r in found:
        assert _base(r["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert kept >= set(range(90)) | {204} and not kept & {100, 101, 102, 200, 201, 203}


def _mcd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense estimate of one group: three starts, C-steps on the same grid of distances, reweighting."""
    floors = np.diag([0.12**2, 0.08**2, 0.12**2, 0.2**2])
    quart = (np.stack([np.sort(np.floor(x * 250), axis=0)[int(np.ceil(p * len(x))) - 1] for p in (0.25, 0.5, 0.75)]) + 0.5) / 250
    best = None
    for start in (1, 0, 2):
        m, c, det = quart[start], np.diag(((quart[2] - quart[0]) / 1.349) ** 2) + floors, np.inf
        while True:
            cell = np.floor(np.log(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + 1e-6) * 32)
            core = x[cell <= np.sort(cell)[int(np.ceil(len(x) / 2)) - 1]]
            new = 2.1091 * np.cov(core.T, bias=True) + floors
            if np.linalg.slogdet(new)[1] / 2 >= det - 1e-9:
                break
            m, c, det = core.mean(axis=0), new, np.linalg.slogdet(new)[1] / 2
        if best is None or det < best[0]:
            best = det, m, c
    _, m, c = best
    near = x[np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) <= 11.1433]
    return near.mean(axis=0), 1.0645 * np.cov(near.T, bias=True) + floors


def test_mcd_by_dense_linear_algebra_with_a_third_of_junk(spark):
    """A tight junk family of a third of the group stays outside; other rows are kept."""
    rng = np.random.default_rng(5)
    good = rng.normal([1.6, 0.02, 0.05, 0.0], [0.1, 0.02, 0.05, 0.05], (400, 4))
    junk = rng.normal([2.6, 1.5, 0.45, 0.9], 0.01, (200, 4))
    x = np.concatenate([good, junk])
    names = [f"x_{i}" for i in range(4)]
    df = spark.createDataFrame([("=en", "=s", *map(float, r)) for r in x], "g_lang string, g_source string, " + ", ".join(f"{c} double" for c in names))
    row = quality_rules.mcd_estimates(df).first()
    m, c = _mcd(x)
    low = np.linalg.cholesky(c)
    assert np.allclose([row[f"m_{i}"] for i in range(4)], m, atol=1e-9)
    assert np.allclose([row[f"l_{i}_{j}"] for i in range(4) for j in range(i + 1)], [low[i, j] for i in range(4) for j in range(i + 1)], atol=1e-9)
    d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    assert (d2[:400] <= quality_rules.CUT).all() and (d2[400:] > quality_rules.CUT).all()


def test_concentration_ends_only_when_nothing_falls(spark, monkeypatch):
    rows = [("=en", "=s", *map(float, r)) for r in np.random.default_rng(4).normal(size=(200, 4))]
    df = spark.createDataFrame(rows, "g_lang string, g_source string, " + ", ".join(f"x_{i} double" for i in range(4)))
    monkeypatch.setattr(quality_rules, "MOST_STEPS", 1)
    with pytest.raises(RuntimeError, match="still falls"):
        quality_rules.mcd_estimates(df)


def test_keep_good_carries_all_columns(spark, mixed):
    out = quality_rules.keep_good(mixed)
    assert out.columns == mixed.columns and out.filter("doc_id = 0").count() == 2
    assert quality_rules.keep_good(mixed.limit(0)).count() == 0


def test_lines_and_windows(spark):
    rows = [(1, "a\n b \na\n\n \na\r\nx y z x y z w"), (2, "α β γ α β γ"), (3, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality_rules.base_statistics(df).select("text", "stats.*").collect():
        assert _base(r["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])


@pytest.fixture(scope="module")
def copies(spark):
    """Originals, exact copies, near copies with few edits, far copies, shared passages, and wordless texts."""
    rng = random.Random(9)
    rows, passage = [], _text(rng, 60)
    for k in range(30):
        base = _text(rng, 220).split()
        rows.append((10 * k, " ".join(base)))
        near = list(base)
        near[100] = "changed"
        rows.append((10 * k + 1, " ".join(near)))
        far = [w if rng.random() > 0.2 else _text(rng, 1) for w in base]
        rows.append((10 * k + 2, " ".join(far)))
        if k < 10:
            rows.append((10 * k + 3, " ".join(base).upper() + "!"))
        rows.append((10 * k + 4, _text(rng, 200) + " " + passage))
    rows += [(900, None), (901, ""), (902, "!!!"), (903, "one two"), (904, "One, two"), (None, _text(rng, 80)), (905, rows[0][1]), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _classes_by_hand(rows) -> dict:
    shingled = []
    for r in rows:
        w = PLAIN.findall((r["text"] or "").translate(ASCII_LOWER))
        shingled.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def common(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                keep = best[j]
                best[j] = last + 1 if x == y else max(best[j], best[j - 1])
                last = keep
        return best[-1]

    counts = [Counter(s) for s in shingled]
    for i in range(len(rows)):
        for j in range(i):
            a, b = shingled[i], shingled[j]
            if a and b and sum((counts[i] & counts[j]).values()) >= 0.8 / 1.8 * (len(a) + len(b)):
                m = common(a, b)
                if m >= 0.8 * (len(a) + len(b) - m):
                    parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups


def test_near_duplicates_by_brute_force(copies):
    rows = copies.collect()
    found = near_duplicates.classes(copies).collect()
    assert len(found) == len(rows)
    expected = Counter()
    for members in _classes_by_hand(rows).values():
        ids = [rows[i]["doc_id"] for i in members]
        least = min((x for x in ids if x is not None), default=None)
        expected.update((rows[i]["doc_id"], least, len(members)) for i in members)
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == expected
    assert sum(r["first"] for r in found) == len(_classes_by_hand(rows))


def test_drop_copies(spark, copies):
    wide = copies.withColumns({"label": F.lit(1), "rid": F.lit("r"), "row": F.lit(0)})
    out = near_duplicates.drop_copies(wide)
    assert out.columns == wide.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and {900, 901, 902, 903} <= set(ids) and not {904, 905, 1} & set(ids)
    assert near_duplicates.drop_copies(wide.limit(0)).count() == 0


def test_banded_alignment_equals_plain_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 9, rng.integers(1, 60))
        b = np.delete(a, rng.integers(0, len(a), 2)) if len(a) > 4 else a
        b = np.insert(b, rng.integers(0, len(b) + 1, 3), rng.integers(0, 9, 3))
        best = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                keep = best[j]
                best[j] = last + 1 if x == y else max(best[j], best[j - 1])
                last = keep
        assert near_duplicates.matched_in_band(a, b, len(a) + len(b)) == best[-1]
        assert near_duplicates.similar(a, b) == (best[-1] >= 0.8 * (len(a) + len(b) - best[-1]) - 1e-9)


@pytest.mark.parametrize("dealt", [near_duplicates.DEALT, 7])
def test_hot_bucket_is_parted(spark, monkeypatch, dealt):
    """Many unlike texts with one long common passage stay apart, near copies among them are found, however many tasks a bucket or head is dealt over."""
    monkeypatch.setattr(near_duplicates, "DEALT", dealt)
    rng = random.Random(4)
    passage = _text(rng, 150)
    rows = [(k, passage + " " + _text(rng, 60)) for k in range(150)]
    rows += [(1000 + k, rows[k][1].replace(rows[k][1].split()[170], "edited", 1)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {tuple(sorted(rows[i][0] for i in m)) for m in _classes_by_hand(df.collect()).values()}
    groups: dict = {}
    for r in near_duplicates.classes(df).collect():
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert {tuple(sorted(g)) for g in groups.values()} == expected


def test_pairs_of_a_hot_bucket_are_all_met_once(spark, monkeypatch):
    """Members outside the largest component of a bucket meet all others of it that the bounds admit, in one task or in many."""
    rng = random.Random(21)
    rows = [(b, rid, rng.randrange(40, 60), rng.randrange(0, 12), rng.randrange(9)) for b in (1, 2, 3) for rid in range(90 if b == 1 else 6)]
    members = spark.createDataFrame(rows, "bucket long, rid long, n long, at int, label long").repartition(5)
    expected = Counter()
    for b in (1, 2, 3):
        own = [r for r in rows if r[0] == b]
        sizes = Counter(r[4] for r in own)
        largest = max(sizes, key=lambda x: (sizes[x], x))
        for r in own:
            for h in own:
                apart = h[4] != largest and r[4] != h[4] and (r[4] == largest or r[1] < h[1])
                if apart and min(r[2] - r[3], h[2] - h[3]) >= math.ceil(0.8 / 1.8 * (r[2] + h[2]) - 1e-9):
                    expected[h[1], r[1]] += 1
    assert sum(expected.values()) > 400  # enough pairs for the test to mean something
    for dealt in (near_duplicates.DEALT, 11, 1):
        monkeypatch.setattr(near_duplicates, "DEALT", dealt)
        assert Counter((r["head"], r["rid"]) for r in near_duplicates._meet_others(members).collect()) == expected


def test_pairs_of_a_hot_head_are_all_verified(spark, monkeypatch):
    rng = random.Random(22)
    head = [rng.randrange(1 << 20) for _ in range(50)]
    rows = [(0, head)] + [(k, head[: 50 - k % 15] + [rng.randrange(1 << 20) for _ in range(k % 15)]) for k in range(1, 80)]
    table = spark.createDataFrame(rows, "rid long, shingles array<int>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 80)] + [(5, 6), (0, 3)], "head long, rid long")
    sequences = {k: np.array(v, dtype=np.int32) for k, v in rows}
    expected = {(min(h, r), max(h, r)) for h, r in pairs.collect() if near_duplicates.similar(sequences[h], sequences[r])}
    assert 20 < len(expected) < 79
    for dealt in (near_duplicates.DEALT, 9, 1):
        monkeypatch.setattr(near_duplicates, "DEALT", dealt)
        assert sorted(map(tuple, near_duplicates._linked(pairs, table).collect())) == sorted(expected)


def test_dealing_crowded_buckets_again_loses_no_pair():
    """2,000 pairs at 0.80 to 0.83 share a bucket after dealing again, and unlike texts with a common passage do not."""
    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(-(2**31), 2**31, n, dtype=np.int32)
    passage, texts = fresh(200), []
    for k in range(2000):
        tail, cut = fresh(56), 24 + k % 5
        texts += [np.concatenate([passage, tail]), np.concatenate([passage, tail[:-cut], fresh(cut)])]
    assert all(near_duplicates.similar(a, b) for a, b in zip(texts[::2], texts[1::2]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array([256] * len(texts)), pa.array(range(len(texts))), pa.array([t.tolist() for t in texts], pa.list_(pa.int32()))], names=["rid", "n", "label", "shingles"]
    )
    found = list(near_duplicates._slot_counts(iter([batch.select(["shingles"])])))[0]
    counts = np.zeros(near_duplicates.SLOTS, dtype=np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    for shift in (0, 2):  # a slice has offsets that do not start at 0
        dealt = next(near_duplicates._prefixes(SimpleNamespace(value=counts))(iter([batch.slice(shift)])))
        keys = [set(k) for k in dealt.column("keys").to_pylist()]
        assert all(a & b for a, b in zip(keys[::2], keys[1::2]))
        assert max(Counter(k for ks in keys for k in ks).values()) <= 48


def test_many_edited_copies_lose_no_link(spark):
    """A family whose members are mostly unlike each other, and pairs at 0.80 to 0.83, against all pairs."""
    rng = random.Random(14)

    def edited(words: list[str], share: float) -> str:
        return " ".join(_text(rng, 1) if rng.random() < share else w for w in words)

    base = _text(rng, 120).split()
    rows = [(k, edited(base, k / 6000)) for k in range(240)]
    passage = _text(rng, 80)
    for k in range(40):
        own = _text(rng, 70).split()
        cut = 8 + k % 6
        rows += [(1000 + 2 * k, f"{passage} {' '.join(own)}"), (1001 + 2 * k, f"{passage} {' '.join(own[:-cut])} {_text(rng, cut)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    expected = {frozenset(rows[i][0] for i in m) for m in _classes_by_hand(df.sparkSession.createDataFrame(rows, "doc_id long, text string").collect()).values()}
    groups: dict = {}
    for r in near_duplicates.classes(df).collect():
        groups.setdefault(r["class_id"], set()).add(r["doc_id"])
    together = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    true = {(a, b) for g in expected for a in g for b in g if a < b}
    assert together <= true and len(together) >= 0.995 * len(true) and len(true) > 500


def _contamination_by_hand(docs, items) -> Counter:
    windows: dict[tuple, set] = {}
    for name, text in items:
        w = PLAIN.findall((text or "").translate(ASCII_LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(name) if name is not None else None)
    sizes = {len(k) for k in windows}
    out = Counter()
    for name, text in docs:
        w = PLAIN.findall((text or "").translate(ASCII_LOWER))
        hit, held = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    held |= windows[tuple(w[k : k + n])]
        held.discard(None)
        out[name, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block", [8_000_000, 900])
def test_contamination_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rng = random.Random(6)
    items = [(k, _text(rng, rng.choice([3, 12, 25]))) for k in range(12)] + [(50, "ba"), (51, None), (52, "..."), (0, None), (None, _text(rng, 15)), (60, "Ünï code WORDS here")]
    docs = [(k, _text(rng, 40) + " " + (items[k % 12][1] if k % 2 else "") + " " + _text(rng, 20)) for k in range(40)]
    docs += [(100, None), (101, ""), (102, items[14 + 2][1]), (103, " ".join(items[3][1].split()[:9])), (104, "x ünï code words HERE"), docs[1], (None, items[1][1].upper()), (105, _text(rng, 30_000))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ranges", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("name", F.lit(1))
    found = decontamination.contamination(frame, bench).drop("text_hash").collect()
    assert Counter(tuple(r) for r in found) == _contamination_by_hand(docs, items)
    clean = decontamination.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(not r["contaminated"] for r in found)


def test_shared_and_repeated_windows_are_tried_once(spark, monkeypatch):
    """One word over and over, and a passage in many items, in small slices."""
    monkeypatch.setattr(decontamination, "SLICE", 100)
    rng = random.Random(16)
    passage = _text(rng, 30)
    items = [(0, "ba " * 300), (1, "ba ba ko")] + [(10 + k, f"{_text(rng, 5)} {passage} {_text(rng, 5)}") for k in range(30)]
    docs = [(0, "ba " * 900), (1, f"{_text(rng, 9)} {passage}"), (2, "ko ba ba ko"), (3, _text(rng, 50)), (3, _text(rng, 50)), (4, "ba " * 9)]
    keys = decontamination.item_windows(pa.array(["ba " * 300, passage, passage]))
    assert len(keys[0]) == 1 + 21 and keys[2][-1] == 1 + 2 * 21
    found = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r) for r in found.drop("text_hash").collect()) == _contamination_by_hand(docs, items)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = decontamination.contamination(docs, bench).first()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (3, 0, 0, False)
    assert decontamination.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
