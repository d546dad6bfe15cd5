"""Operator 8: exact byte-pair encoding by dynamic programming over prefixes.

The encoding of every prefix of a piece ends in exactly one token.  An automaton
finds the vocabulary entries that end at each byte; an entry is that last token
when it stands next to the last token of the prefix before it, that is when no
merge across their border would have come first.  Following the stored tokens
back from the end gives the ids.  A piece takes time linear in its length times
the entries that end at a byte, however its merges are nested.

Cases
* null text counts as empty and gives no ids;
* strings of added tokens in a text become their ids, as the file's tokenizer does;
* a definition with a normalizer, another splitter or special flags raises ``ValueError``;
* decoding unknown ids is an error; bytes that are no UTF-8 decode to U+FFFD;
* repeated rows and null ids are encoded like others;
* workers forget pieces at the end of a task, so idle ones hold the vocabulary's tables only;
* extra columns are carried through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Split of a text into pieces; fixed value of byte-level tokenizers.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that the memo of pieces and that of token pairs may hold in a Python worker.
MEMO = 400_000
#: Code points of the longest piece that is remembered, so that entries bound the memo's memory as well.
LONG = 64


def byte_letters() -> dict[str, int]:
    """Letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Pieces(dict):
    """Memo from piece to its ids as little-endian int32 bytes."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.coder.encode_piece(piece.encode()), dtype="<i4").tobytes()
        if len(self) < MEMO and len(piece) <= LONG:
            self[piece] = ids
        return ids


def checked(definition: str) -> dict:
    """The parsed definition; one that asks for more than byte-level pair encoding raises ``ValueError``."""
    parsed = json.loads(definition)
    model, before = parsed["model"], parsed.get("pre_tokenizer") or {}
    faults = [
        name
        for name, found in (
            ("a model other than BPE", model.get("type", "BPE") != "BPE"),
            ("a normalizer", parsed.get("normalizer") is not None),
            ("a pre-tokenizer other than ByteLevel with its own pattern", before.get("type") != "ByteLevel" or before.get("use_regex") is False),
            ("a space before the text", before.get("add_prefix_space", True)),
            ("ignore_merges", bool(model.get("ignore_merges"))),
            ("dropout, prefix or suffix", bool(model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))),
            ("an added token that takes spaces or whole words", any(t.get(k) for t in parsed.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))),
        )
        if found
    ]
    if faults:
        raise ValueError("not supported: " + ", ".join(faults))
    return parsed


class Alphabet:
    """Bytes of every token, end to end: all that decoding needs."""

    def __init__(self, parsed: dict):
        letters = byte_letters()
        own = {i: bytes(letters[c] for c in s) for s, i in parsed["model"]["vocab"].items()}
        own |= {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", [])}
        size = max(own) + 1
        self.lengths = np.array([len(own.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.joined = np.frombuffer(b"".join(own.get(i, b"") for i in range(size)), dtype=np.uint8)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all tokens one after the other."""
        size = self.lengths[ids]
        first = np.repeat(self.offsets[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(ids) else np.zeros(0, dtype=np.int64)
        return self.joined[first + np.arange(len(first))]


class Coder:
    """Encoder of one byte-level vocabulary."""

    def __init__(self, parsed: dict):
        letters = byte_letters()
        vocab: dict[str, int] = parsed["model"]["vocab"]
        self.bytes = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in parsed["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.made = {vocab[a + b]: (k, vocab[a], vocab[b]) for k, (a, b) in reversed(list(enumerate(merges)))}
        self.single = {b: vocab[c] for c, b in letters.items() if c in vocab}
        self.added = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.ends = ahocorasick.Automaton()
        for i, word in self.bytes.items():
            if i not in self.added.values() or i in vocab.values():
                self.ends.add_word(word.decode("latin-1"), (i, len(word)))
        self.ends.make_automaton()
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(PIECES).findall
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.pieces = Pieces(self)

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens on the border of ``token`` over time, each with the rank of the merge that ends it."""
        spine, until = [], len(self.rank) + 1
        while True:
            spine.append((token, until))
            made = self.made.get(token)
            if made is None:
                return spine
            until, token = made[0], made[side]

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stay two tokens: no merge over the border comes first.

        On equal ranks the left pair merges first.
        """
        key = a << 32 | b
        known = self.beside.get(key)
        if known is None:
            spine_a = self.right.get(a) or self.right.setdefault(a, self._border(a, 2))
            spine_b = self.left.get(b) or self.left.setdefault(b, self._border(b, 1))
            known = True
            for x, until_x in spine_a:
                for y, until_y in spine_b:
                    rank = self.rank.get((x, y))
                    if rank is not None and rank < until_x and rank <= until_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.beside) >= MEMO:
                self.beside.clear()
            self.beside[key] = known
        return known

    def _reached(self, token: int) -> bool:
        """Whether the encoding of a token's own bytes is that token."""
        known = self.whole.get(token)
        if known is None:
            made = self.made.get(token)
            known = made is None or (self._reached(made[1]) and self._reached(made[2]) and self._joins(made[1], made[2], made[0]))
            self.whole[token] = known
        return known

    def _joins(self, a: int, b: int, rank: int) -> bool:
        """Whether the first merge over the border of ``a`` and ``b`` is theirs."""
        for x, until_x in self._border(a, 2):
            for y, until_y in self._border(b, 1):
                other = self.rank.get((x, y))
                if other is not None and (x, y) != (a, b) and other < until_x and other <= until_y:
                    return False
        return self.rank.get((a, b)) == rank

    def encode_piece(self, data: bytes) -> list[int]:
        last: list[tuple[int, int] | None] = [None] * (len(data) + 1)
        for end, (token, size) in self.ends.iter(data.decode("latin-1")):
            end += 1
            if last[end] is None:
                start = end - size
                if start == 0:
                    if self._reached(token):
                        last[end] = (token, 0)
                elif (before := last[start]) is not None and self.fits(before[0], token) and self._reached(token):
                    last[end] = (token, start)
        out, at = [], len(data)
        while at:
            token, at = last[at]
            out.append(token)
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian int32 bytes."""
        if self.split is None:
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        parts = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                parts.append(np.array([self.added[part]], dtype="<i4").tobytes())
            else:
                parts += map(self.pieces.__getitem__, self.find(part))
        return b"".join(parts)

    def forget(self) -> None:
        """Drop all memos; the vocabulary's own tables stay.

        An executor keeps idle Python workers and deals tasks to them in turn, so
        what a worker remembers between tasks is held once for each of them.
        """
        for memo in (self.pieces, self.beside, self.whole, self.right, self.left):
            memo.clear()
        pa.default_memory_pool().release_unused()


_READY: dict[tuple[type, int], Coder | Alphabet] = {}


def _ready(shared, kind: type) -> Coder | Alphabet:
    """The coder or alphabet of a broadcast definition, built once in each Python worker."""
    if (kind, shared.id) not in _READY:
        for other in [k for k in _READY if k[1] != shared.id]:
            del _READY[other]
        _READY[kind, shared.id] = kind(json.loads(shared.value))
    return _READY[kind, shared.id]


class _Shared:
    """A broadcast definition that names itself."""

    def __init__(self, spark: SparkSession, definition: str):
        checked(definition)
        self.sent = spark.sparkContext.broadcast(definition)
        self.id = hash(definition)

    @property
    def value(self) -> str:
        return self.sent.value


def load(path: str) -> str:
    """The tokenizer definition at ``path`` (a file of a few MB), read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, definition: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` without ``text`` and with ``ids``, the token ids of the whole text."""
    shared = _Shared(docs.sparkSession, definition)
    kept = [c for c in docs.columns if c not in (text, ids)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ready(shared, Coder)
        try:
            for batch in batches:
                # A few texts at a time bound the memory, however long they are.
                column, first = batch.column(1), 0
                while first < batch.num_rows:
                    parts, total, stop = [], 0, first
                    while stop < batch.num_rows and total < 8_000_000:
                        parts.append(coder.encode(column[stop].as_py()))
                        total += len(parts[-1])
                        stop += 1
                    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
                    flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:stop], lists], names=["row", "ids"])
                    first = stop
        finally:
            coder.forget()

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, ids array<int>")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.col("ids").alias(ids))


def decode(encoded: DataFrame, definition: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with ``text``, decoded from ``ids``; null ids count as none."""
    shared = _Shared(encoded.sparkSession, definition)
    kept = [c for c in encoded.columns if c != text]
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = _ready(shared, Alphabet)
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            first = 0
            while first < batch.num_rows:
                stop = max(first + 1, int(np.searchsorted(ends, ends[first] + 500_000, side="right")) - 1)
                own = values[ends[first] : ends[stop]]
                raw = alphabet.decode_bytes(own)
                size = np.concatenate([[0], np.cumsum(alphabet.lengths[own])])
                cuts = size[ends[first : stop + 1] - ends[first]]
                view = raw.tobytes()
                texts = [view[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:stop], pa.array(texts, pa.string())], names=["row", "body"])
                first = stop

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, body string").select(*[F.col("row")[c].alias(c) for c in kept], F.col("body").alias(text))


def round_trip(docs: DataFrame, definition: str, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of encoding and decoding: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Both ways run in one Python worker, so ids do not travel back and forth.
    """
    shared = _Shared(docs.sparkSession, definition)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, alphabet = _ready(shared, Coder), _ready(shared, Alphabet)
        try:
            for batch in batches:
                counts, ids_sums, text_sums = [], [], []
                for body in batch.column(1):
                    ids = np.frombuffer(coder.encode(body.as_py()), dtype="<i4")
                    decoded = alphabet.decode_bytes(ids).tobytes().decode("utf-8", "replace")
                    counts.append(len(ids))
                    ids_sums.append(sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                    text_sums.append(sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(text_sums, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            coder.forget()

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
