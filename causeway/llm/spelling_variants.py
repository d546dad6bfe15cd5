"""Operator 12: spelling variants by a frontier of states over a relational trie.

The trie of all words is a table of edges (parent, letter, node).  Two words at
distance one share a prefix, take one edit, and then the same letters.  So the
states start at every node of the trie, one for each pair of its children: either
one child's letter replaces the other's, or one letter is inserted before the
other.  Words with the same prefix share their states.  Each round joins the
frontier with the edge table, one edge further, until no state is left; a state whose
two sides both end a word is a pair of neighbours.

Nodes with one way on are passed over: an edge holds all letters to the next node
where words branch or end, or to the end of a single word.  A state compares what its
two sides have ahead at once and joins the edges of a side that has nothing ahead.  So
there are as many rounds as branchings on a path, however long the words are.

An edit within a run of equal letters is taken as the last one of the run, so each
pair is found once.

Cases
-----
* Null or empty texts have no words; a null id counts as empty.  Copies and repeated
  rows count each time.  Extra columns are not read.
* Words of any length are whole; texts are read whole, one at a time.
* Ties among forms go to the least word in code-point order.
* No rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.textkit import mix
from causeway.staging import stage

#: Fewest letters of a word, fewest occurrences, and how many times more often a form occurs than its variant.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: Of the pairs of text and word, one in so many loses a letter.
DAMAGED = 31
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a counting task holds before it sends them on.
HELD = 100_000
#: States that are broadcast, about 100 bytes each.
FRONTIER = 20_000
#: Words that are numbered at once.
SOME = 4096
_BASE = 0x9E3779B97F4A7C15 | 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts in ``(doc_id as text, text)``."""
    seen: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            name = zlib.crc32(((doc.as_py() if doc.is_valid else "") + ":").encode())
            for word, n in Counter(_RUN.findall(text.as_buffer().to_pybytes().lower().decode())).items():  # lower() of bytes changes A to Z only
                if len(word) < LETTERS:
                    continue
                key = zlib.crc32(word.encode(), name)
                if key % DAMAGED == 0:
                    at = key % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LETTERS:
                        continue
                seen[word] += n
            if len(seen) >= HELD:
                yield sent()
    if seen:
        yield sent()


def vocabulary(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of at least ``LETTERS`` letters and ``OCCURRENCES`` occurrences as ``(word, n)``."""
    texts = docs.select(F.col(f"`{id_column}`").cast("string").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def _numbers(words: list[str]) -> tuple[np.ndarray, ...]:
    """Letters of all words, their places, and the numbers of the prefixes that end there and just before."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    first = np.repeat(ends - size, size)
    at = np.arange(len(letters)) - first
    power = np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(mix(letters.astype(np.uint64) + np.uint64(1)) * power[at], out=total[1:])
    here = mix(total[1:] - total[first] + (at + 1).astype(np.uint64)).view(np.int64)
    before = np.where(at > 0, np.concatenate([[0], here[:-1]]), 0)
    return letters, at, here, before, ends, size


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each word."""
    for batch in batches:
        for some in range(0, batch.num_rows, SOME):
            part = batch.slice(some, SOME)
            _, _, here, _, ends, _ = _numbers(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(here[ends - 1])], names=["word", "n", "number"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each word: its number, that of the prefix before it, its last letter, and whether it is the word."""
    for batch in batches:
        for some in range(0, batch.num_rows, SOME):
            letters, at, here, before, ends, size = _numbers(batch.column(0).slice(some, SOME).to_pylist())
            whole = np.zeros(len(letters), bool)
            whole[ends - 1] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(before), pa.array(letters.astype(np.int32)), pa.array(here), pa.array((at + 1).astype(np.int32)), pa.array(np.repeat(here[ends - 1], size)), pa.array(whole)],
                names=["parent", "letter", "node", "depth", "number", "whole"],
            )


def _chain_ends(chains: DataFrame) -> DataFrame:
    """The node that ends the chain from each of ``chains(node, end)``, where ``end`` is first the next node; rounds double."""
    ends = stage(chains, "op12-chains")
    while True:
        on = ends.select(F.col("node").alias("end"), F.col("end").alias("far"))
        ends = stage(ends.join(on, "end", "left").select("node", F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("moved")), "op12-chains")
        if ends.filter("moved").isEmpty():
            return ends.select("node", "end")
        ends = ends.select("node", "end")


def edges(words: DataFrame) -> DataFrame:
    """The trie of ``words(word, number)`` below its nodes of several words, as a staged edge table.

    Nodes that end no word and have one child are passed over, so an edge has its
    first ``letter`` and, as ``tail``, all letters after it.  It leads to ``node``, of
    several words, one of which ``ends`` there or not, or to a single ``word``; the
    other of the two is null.  ``stem_ends`` says whether ``parent`` ends a word.
    """
    every = words.select("word").mapInArrow(_prefixes, "parent long, letter int, node long, depth int, number long, whole boolean")
    counted = every.groupBy("parent", "letter", "node").agg(F.count("*").alias("n"), F.min("depth").alias("depth"), F.min("number").alias("number"), F.max("whole").alias("ends"))
    counted = stage(counted, "op12-nodes")
    children = counted.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.max("node").alias("only"))
    crowded = stage(counted.filter("n > 1").select("node", "depth", "ends").join(children, "node", "left"), "op12-crowded")
    passed = "not ends and children = 1"
    chains = _chain_ends(crowded.filter(passed).select("node", F.col("only").alias("end")))
    stems = crowded.filter(f"not ({passed})").select(F.col("node").alias("parent"), F.col("ends").alias("stem_ends"))
    inner = counted.join(stems, "parent", "left").filter("parent = 0 or stem_ends is not null").withColumn("stem_ends", F.coalesce("stem_ends", F.lit(False)))
    far = chains.join(crowded.select(F.col("node").alias("end"), F.col("depth").alias("end_depth"), F.col("ends").alias("end_ends")), "end")
    led = inner.join(far, "node", "left")
    plain = led.filter("n > 1 and end is null").select("parent", "letter", "stem_ends", F.lit("").alias("tail"), "node", "ends", F.lit(None).cast("long").alias("word"))
    named = led.filter("n = 1 or end is not null").join(words.select("number", "word"), "number")
    tail = F.expr("CASE WHEN n = 1 THEN substring(word, depth + 1) ELSE substring(word, depth + 1, end_depth - depth) END")
    single = F.col("n") == 1
    named = named.select("parent", "letter", "stem_ends", tail.alias("tail"), F.when(~single, F.col("end")).alias("node"), F.when(single, F.col("ends")).otherwise(F.col("end_ends")).alias("ends"), F.when(single, F.col("number")).alias("word"))
    return stage(plain.unionByName(named), "op12-edges")


_SIDE = ("tail", "node", "ends", "word")


def _child(name: str) -> list[Column]:
    """Columns of an edge's end as one side of a state."""
    return [F.col(c).alias(f"{name}_{c}") for c in _SIDE]


def _trimmed(states: DataFrame) -> DataFrame:
    """States without the letters that both sides have ahead; those that differ there are gone."""
    both = F.least(F.length("x_tail"), F.length("y_tail"))
    kept = states.withColumn("both", both).filter("left(x_tail, both) = left(y_tail, both)")
    return kept.withColumns({c: F.expr(f"substring({c}, both + 1)") for c in ("x_tail", "y_tail")}).drop("both").filter(f"({_OPEN}) or ({_MET})")


#: Both sides have ended in a word; a side at a node of several words waits for letters.
_MET = "x_tail = '' and y_tail = '' and (x_word is not null or x_ends) and (y_word is not null or y_ends)"
_OPEN = "(x_tail = '' and x_node is not null and y_tail <> '') or (y_tail = '' and y_node is not null and x_tail <> '') or (x_tail = '' and y_tail = '' and x_node is not null and y_node is not null)"


def _met(states: DataFrame) -> DataFrame:
    """Pairs of words that states have reached, as ``(a, b)``."""
    return states.filter(_MET).select(F.coalesce("x_word", "x_node").alias("a"), F.coalesce("y_word", "y_node").alias("b"))


def _one_edge_on(states: DataFrame, trie: DataFrame, small: bool) -> DataFrame:
    """States whose sides have read on along an edge, the same letters on both."""

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if small else rows

    many = states.filter("x_tail = '' and y_tail = ''").select(F.col("x_node").alias("parent"), F.col("y_node").alias("other"))
    read = trie.join(sent(many), "parent").select("letter", *_child("x"), "other")
    x_waits = F.col("x_tail") == ""
    ahead = states.filter("x_tail <> '' or y_tail <> ''").select(*[F.when(x_waits, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(f"x_{c}") for c in _SIDE], F.when(x_waits, F.col("x_node")).otherwise(F.col("y_node")).alias("other"))
    ahead = ahead.select(F.ascii("x_tail").alias("letter"), F.expr("substring(x_tail, 2)").alias("x_tail"), *[f"x_{c}" for c in _SIDE[1:]], "other")
    own = trie.select(F.col("parent").alias("other"), "letter", *_child("y"))
    return _trimmed(own.join(sent(read.unionByName(ahead)), ["other", "letter"]).drop("other", "letter"))


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs of ``words(word, n, number)`` at distance one, each once, as staged ``(a, b)`` numbers."""
    trie = edges(words)
    x = trie.select("parent", F.col("letter").alias("x_letter"), *_child("x"))
    y = trie.select("parent", F.col("letter").alias("y_letter"), *_child("y"))
    pairs = x.join(y, "parent").filter("x_letter <> y_letter")
    sides = [f"{k}_{c}" for k in "xy" for c in _SIDE]
    replaced = pairs.filter("x_letter < y_letter").select(*sides)
    # y's letter stands before that of x, so x is still to be read from its first letter on
    inserted = pairs.withColumn("x_tail", F.concat(F.char("x_letter"), "x_tail")).select(*sides)
    added = trie.filter("stem_ends and tail = '' and (word is not null or ends)").select(F.col("parent").alias("a"), F.coalesce("word", "node").alias("b"))
    states = stage(_trimmed(replaced.unionByName(inserted)), "op12-frontier")
    found = [stage(added, "op12-pairs")]
    while True:
        found.append(_met(states))
        left = states.filter(_OPEN)
        count = left.limit(FRONTIER + 1).count()
        if count == 0:
            break
        states = stage(_one_edge_on(left, trie, count <= FRONTIER), "op12-frontier")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stage(out, "op12-neighbours")


def _roots(forms: DataFrame) -> DataFrame:
    """The last form from each of ``forms(word, form)``; a form occurs ten times as often as its word, so chains end."""
    up = stage(forms.select("word", F.col("form").alias("root")), "op12-roots")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = stage(up.join(over, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "op12-roots")
        up = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return up


def variants(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Words with their neighbours and forms.

    Returns a row per word: ``form`` (its neighbour that occurs most, if at least
    ``TIMES`` as often, else null), ``root`` (the end of the chain of forms), ``n``
    (occurrences), ``n_near`` (neighbours) and ``form_n``.
    """
    words = stage(vocabulary(docs, id_column=id_column, text=text).mapInArrow(_numbered, "word string, n long, number long"), "op12-words")
    pairs = neighbours(words)
    left = words.select(F.col("number").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    right = words.select(F.col("number").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    named = pairs.join(left, "a").join(right, "b").filter(F.levenshtein("word_a", "word_b", 1) == 1)  # numbers may clash, words do not
    ends = F.array(F.struct(F.col("word_a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("word_b").alias("form")).alias("near")), F.struct(F.col("word_b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("word_a").alias("form")).alias("near")))
    near = named.select(F.explode(ends).alias("e")).groupBy("e.word").agg(F.count("*").alias("n_near"), F.min("e.near").alias("best"))
    told = words.join(near, "word", "left")
    told = stage(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best")).alias("best")), "op12-forms")
    roots = _roots(told.filter("best is not null").select("word", F.col("best.form").alias("form")))
    return told.join(roots, "word", "left").select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n"))
