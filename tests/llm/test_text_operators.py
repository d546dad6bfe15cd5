"""Secrets, encoding, classification and language model: edge cases and brute force."""

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

from causeway.llm import bpe, language_model, quality_classifier, queries, secrets

DATA = "/root/testdata/sf0.001"


def _secrets_by_hand(text: str | None) -> list[str]:
    text = text or ""
    rules = [("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    spans = [(m.start(), k, m.end()) for k, (_, p, part, least) in enumerate(rules) for m in re.finditer(p, text) if len(m.group(part)) >= least]
    return [f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(spans)]


SECRET_TEXTS = [
    None,
    "",
    "token=token: abcdef",
    "secret=token=abcdefgh password : 'hunter22'",
    "éé😀 passwd=é secret=ABCDEF01 " + "AKIA" + "B2" * 9,
    "AKIA" + "A" * 15 + " AKIA" + "A" * 16,
    "x" + "0f" * 12 + "y " + "a" * 23,
    "API_KEY: \"k-1.2+3/4=\" apikey=short api__key=abcdefgh",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " xoxb-1234567890-ab",
    "PaSsWoRd = abc.def " * 300,
]


def test_secret_spans(spark):
    df = spark.createDataFrame([*enumerate(SECRET_TEXTS), (1, ""), (None, SECRET_TEXTS[4])], "doc_id long, text string").withColumn("spans", F.lit("x"))
    rows = secrets.scan(df).select("row.doc_id", "row.text", "n_assign", "n_access", "n_hex", "base_spans", "spans").collect()
    assert len(rows) == len(SECRET_TEXTS) + 2
    for r in rows:
        expected = _secrets_by_hand(r["text"])
        assert r["base_spans"] == ",".join(expected)
        kinds = Counter(s.split(":")[0] for s in expected)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(expected) <= set(r["spans"].split(",") if r["spans"] else [])
    more = next(r["spans"] for r in rows if r["doc_id"] == 8)
    assert {"private_key", "code_host", "chat"} <= {s.split(":")[0] for s in more.split(",")}


def test_redaction_leaves_no_secret(spark):
    df = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string").withColumn("row", F.lit(1))
    out = secrets.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert not _secrets_by_hand(r["text"])
        if not _secrets_by_hand(SECRET_TEXTS[r["doc_id"]]) and r["doc_id"] != 8:
            assert r["text"] == SECRET_TEXTS[r["doc_id"]]
    assert secrets.redact(df.limit(0)).count() == 0


@pytest.mark.parametrize("pattern, query", [("abcd", ("and", ("abc", "bcd"))), ("[0-9a-f]+", True), ("ab?cde", ("or", (("and", ("abc", "bcd", "cde")), ("and", ("acd", "cde"))))), ("x+foo", "foo")])
def test_trigram_queries(pattern, query):
    assert secrets.trigram_query(pattern) == query


def test_trigram_queries_never_lose_a_match():
    rng = random.Random(1)
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        holds = lambda q, t: q is True or (q in t if isinstance(q, str) else (all if q[0] == "and" else any)(holds(p, t) for p in q[1]))
        for _ in range(300):
            text = "".join(rng.choice(["password", "TOKEN", "api", "_", "key", "=", ":", " ", "AKIA", "0f3a", "Zz9", "xoxb-", "eyJ", ".", "ghp_", "AIza"]) for _ in range(12))
            if re.search(rule.pattern, text):
                assert holds(query, text.lower())


@pytest.fixture(scope="module")
def definition():
    return bpe.load(queries.tokenizer_path())


def test_encoding_equals_the_library(spark, definition):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(8)
    texts = ["", "<|endoftext|>a b<|endoftext|>", "a" * 3000, " " * 200 + "x", "日本語テキスト" * 30, "I'll don't 've\n\n \t x", "aaaabbbb " * 40, "ſ K İ \x00\x01"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 2000), 0x1F600])) for _ in range(800)) for _ in range(5)]
    texts += ["".join(rng.choice("abetion srh") for _ in range(2000)) for _ in range(5)]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[3]), (0, None)], "doc_id long, text string").withColumn("row", F.lit(1))
    encoded = bpe.encode(df, definition)
    assert set(encoded.columns) == {"doc_id", "row", "ids"}
    for r in bpe.decode(encoded, definition).collect():
        text = texts[r["doc_id"]] if r["doc_id"] else r["text"]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["text"] == text == library.decode(ids, skip_special_tokens=False)
    row = bpe.round_trip(df.filter("doc_id = 4"), definition).first()
    ids = library.encode(texts[4], add_special_tokens=False).ids
    assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert row["decoded_sha256"] == hashlib.sha256(texts[4].encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), definition).count() == 0


@pytest.mark.parametrize("way", ["round_trip", "encode"])
def test_idle_workers_hold_no_memo(spark, definition, way):
    """Tasks go to the idle workers in turn: a memo left in each of them adds up in an executor."""
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abetionsrh", k=9)) for _ in range(50))) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert len(getattr(bpe, way)(df, definition).collect()) == 64

    def held(batches):
        for batch in batches:
            coders = [c for (kind, _), c in bpe._READY.items() if kind is bpe.Coder]
            n = sum(len(m) for c in coders for m in (c.pieces, c.beside, c.whole, c.right, c.left))
            yield pa.RecordBatch.from_pydict({"coders": [len(coders)] * batch.num_rows, "n": [n] * batch.num_rows})

    seen = spark.range(0, 32, numPartitions=32).mapInArrow(held, "coders long, n long").collect()
    assert sum(r["coders"] for r in seen) > 0
    assert sum(r["n"] for r in seen) == 0


def test_long_pieces_are_not_remembered(definition):
    coder = bpe.Coder(bpe.checked(definition))
    text = "ab" * 5000 + " short"
    ids = coder.encode(text)
    assert list(coder.pieces) == [" short"]
    coder.forget()
    assert not coder.pieces and coder.encode(text) == ids


def test_unsupported_definitions_raise(definition):
    import json

    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True})):
        with pytest.raises(ValueError, match="not supported"):
            bpe.checked(json.dumps(json.loads(definition) | {key: value}))


def test_every_token_encodes_as_by_merging(definition):
    coder = bpe.Coder(bpe.checked(definition))

    def merged(data: bytes) -> list[int]:
        ids = [coder.single[b] for b in data]
        while len(ids) > 1:
            ranks = [coder.rank.get(p, 1 << 30) for p in zip(ids, ids[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 30:
                break
            token = next(t for t, (r, _, _) in [(coder_token, coder.made[coder_token]) for coder_token in by_rank[ranks[k]]] if r == ranks[k])
            ids[k : k + 2] = [token]
        return ids

    by_rank: dict[int, list[int]] = defaultdict(list)
    for token, (rank, _, _) in coder.made.items():
        by_rank[rank].append(token)
    rng = random.Random(2)
    for token in rng.sample(sorted(coder.bytes), 400):
        if token not in coder.added.values():
            assert coder.encode_piece(coder.bytes[token]) == merged(coder.bytes[token])
    for _ in range(200):
        data = bytes(rng.choice(b"abetionsrh AB.'") for _ in range(rng.randint(1, 40)))
        assert coder.encode_piece(data) == merged(data)


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = quality_classifier.scores(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.collect())


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "word " * 50_000), (3, "again")], "doc_id long, text string").withColumn("x", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.scores(docs, none).collect()
    assert len(rows) == 5 and {r["score"] for r in rows} == {0.5}
    one = spark.createDataFrame([(2, 1), (3, 1), (3, None)], "doc_id long, quality int")
    assert all(r["score"] >= 0.5 for r in quality_classifier.scores(docs, one).collect())
    assert quality_classifier.scores(docs.limit(0), one).count() == 0


def _statistics_by_hand(text: str) -> list[float]:
    data = text.encode()
    found = [w for w in re.split(rb"[ \t-\r]+", data) if w]
    low = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in found]
    runs = [tuple(low[i : i + 3]) for i in range(max(len(low) - 2, min(len(low), 1)))]
    size, many = max(len(data), 1), max(len(found), 1)
    share = lambda keep: sum(keep(b) for b in data) / size
    return [
        math.log1p(len(data)), math.log1p(len(found)), sum(map(len, found)) / many, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57),
        share(lambda b: chr(b) in "#*$%&|<>@^~=_{}[]\\"), share(lambda b: chr(b) in "!?;:\"'()-/"), share(lambda b: b >= 128), 1 - sum(map(len, found)) / size, share(lambda b: b == 10),
        len(set(low)) / many, 1 - len(set(runs)) / max(len(runs), 1), sum(len(w) == 1 for w in found) / many, sum(len(w) > 14 for w in found) / many,
    ]


def test_classifier_by_dense_algebra(spark):
    """Statistics, random cosines, ridge and pooled violators from their definitions, scores equal to 1e-9."""
    rng = random.Random(21)
    word = lambda junk: "".join(rng.choice("#$%AX01" if junk and rng.random() < 0.3 else "aeitnsr\u00e9") for _ in range(rng.randint(1, 18)))
    rows = [(k, " ".join(word(k % 3 == 0) for _ in range(rng.randint(0, 90))) + "\n" * (k % 4)) for k in range(160)]
    labels = [(k, int(k % 3 != 0) if rng.random() < 0.9 else int(k % 3 == 0)) for k in range(160)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    spare = {r[0] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(quality_classifier.SPARE)) == 0).select("doc_id").collect()}
    x, y = np.array([_statistics_by_hand(t) for _, t in rows]), np.array([q for _, q in labels], dtype=float)
    learnt = np.array([zlib.crc32(str(k).encode()) % 3 != 1 for k in range(160)])
    ridge, after = learnt & [k not in spare for k in range(160)], learnt & [k in spare for k in range(160)]
    draw = np.random.default_rng(quality_classifier.SEED)
    waves, phases = draw.normal(scale=1 / quality_classifier.WIDTH, size=(14, quality_classifier.COSINES)), draw.uniform(0, 2 * np.pi, quality_classifier.COSINES)
    z = np.clip((x - x[ridge].mean(axis=0)) / np.maximum(x[ridge].std(axis=0), 1e-3), -6, 6)
    wide = np.column_stack([np.ones(160), np.cos(z @ waves + phases) * math.sqrt(2 / quality_classifier.COSINES)])
    square = wide[ridge].T @ wide[ridge] + quality_classifier.RIDGE * ridge.sum() * np.diag([0.0] + [1.0] * quality_classifier.COSINES)
    raw = wide @ np.linalg.solve(square, wide[ridge].T @ y[ridge])
    cell = np.clip((raw + 1) * 200, 0, 599).astype(int)
    level = {c: [sum(y[after & (cell == c)]), int((after & (cell == c)).sum())] for c in set(cell[after].tolist())}
    blocks = [[[c], *level[c]] for c in sorted(level)]
    while any(a[1] * b[2] >= b[1] * a[2] for a, b in zip(blocks, blocks[1:])):
        k = next(k for k, (a, b) in enumerate(zip(blocks, blocks[1:])) if a[1] * b[2] >= b[1] * a[2])
        blocks[k : k + 2] = [[blocks[k][0] + blocks[k + 1][0], blocks[k][1] + blocks[k + 1][1], blocks[k][2] + blocks[k + 1][2]]]
    centre = [(sum(c * level[c][1] for c in own) / n + 0.5) / 200 - 1 for own, _, n in blocks]
    expected = np.interp(raw, centre, [g / n for _, g, n in blocks])
    found = {r["doc_id"]: r["score"] for r in quality_classifier.scores(docs, known).collect()}
    assert np.allclose([found[k] for k in range(160)], expected, atol=1e-9)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 20, 50)
    good = np.array([rng.binomial(n, k / 50) for k, n in enumerate(total)])
    centre, level = quality_classifier.isotonic(np.arange(50), total, good)
    assert (np.diff(level) > 0).all() and (np.diff(centre) > 0).all()


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _weighted_by_hand(train: list[str], texts: list[str], depth: int) -> list[float]:
    """Context-tree weighting from its definition, with nodes in dictionaries."""
    count: list = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    below: list = [defaultdict(set) for _ in range(depth + 1)]

    def bits(text: str):
        data = bytes([255] * depth) + text.translate(LOWER).encode() + b"\xff"
        for p in range(depth, len(data)):
            for k in range(8):
                yield data, p, 1 << k | data[p] >> (8 - k), data[p] >> (7 - k) & 1

    for text in train:
        for data, p, node, bit in bits(text):
            for d in range(depth + 1):
                count[d][data[p - d : p], node][bit] += 1
                if d < depth:
                    below[d][data[p - d : p], node].add(data[p - d - 1])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo: dict = {}

    def weighted(context: bytes, node: int, d: int) -> float:
        if (context, node) not in count[d]:
            return 0.0
        if (context, node) not in memo:
            own = kt(*count[d][context, node])
            if d == depth:
                memo[context, node] = own
            else:
                rest = sum(weighted(bytes([x]) + context, node, d + 1) for x in below[d][context, node])
                top = max(own, rest)
                memo[context, node] = top + math.log(math.exp(own - top) + math.exp(rest - top)) - math.log(2)
        return memo[context, node]

    out = []
    for text in texts:
        total = 0.0
        for data, p, node, bit in bits(text):
            chance, rest = 0.0, 1.0
            for d in range(depth + 1):
                context = data[p - d : p]
                a, b = count[d].get((context, node), (0, 0))
                share = 1.0 if d == depth else math.exp(kt(a, b) - weighted(context, node, d) - math.log(2))
                chance, rest = chance + rest * share * (b + 0.5) / (a + b + 1), rest * (1 - share)
            total += math.log10(chance if bit else 1 - chance)
        out.append(total)
    return out


@pytest.mark.parametrize("head", [400_000, 40])
def test_language_model_by_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "Thing", "was", "né", "over", "x"]) + rng.choice(["", "s", "!"]) for _ in range(rng.randint(1, 25))) for _ in range(40)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "\t \n"), (None, "the null id"), (3, texts[3]), (903, "the long one " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    depth = 2 if head == 40 else language_model.DEPTH
    found = language_model.scores(df, depth=depth).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [t or "" for i, t in rows if not out(i)]
    count: Counter = Counter()
    for t in train:
        count.update([*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), "\n"])
    whole, distinct = sum(count.values()), len(count)
    model = _weighted_by_hand(train, [t or "" for _, t in rows], depth)
    expected = defaultdict(list)
    for (i, t), score in zip(rows, model):
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\n"]
        base = sum(math.log10((count[w] + 0.5) / (whole + 0.5 * (distinct + 1))) for w in tokens)
        expected[i].append((out(i), len(tokens), sum(count[w] > 0 for w in tokens), base, score))
    assert len(found) == len(rows)
    for r in found:
        held, n, known, base, score = expected[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, whole)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-7)


def test_language_models_of_one_session_do_not_mix(spark):
    """Five tables, one after the other in the same Python workers, against a plain count of words."""
    for seed in range(5):
        rng = random.Random(seed)
        rows = [(k, " ".join(f"w{rng.randint(0, 8 + 4 * seed)}" for _ in range(20))) for k in range(30)]
        train = [t for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1]
        count = Counter(w for t in train for w in [*t.split(), ""])
        whole = sum(count.values()) + 0.5 * (len(count) + 1)
        found = {r["doc_id"]: r for r in language_model.scores(spark.createDataFrame(rows, "doc_id long, text string"), depth=1).collect()}
        for k, t in rows:
            assert found[k]["n_known"] == sum(count[w] > 0 for w in [*t.split(), ""])
            assert found[k]["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / whole) for w in [*t.split(), ""]), rel=1e-9)


def test_language_model_without_training_text(spark):
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = language_model.scores(spark.createDataFrame([(out, "ab")], "doc_id long, text string"), depth=2).first()
    assert row["base_score"] == pytest.approx(2 * math.log10(1.0)) and row["score"] == pytest.approx(24 * math.log10(0.5))
    assert language_model.scores(spark.createDataFrame([], "doc_id long, text string"), depth=2).count() == 0
