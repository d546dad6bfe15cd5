"""Operator 1: secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that
any match must contain.  An index over the rules' trigrams maps trigram to rows;
its postings are intersected per row, and only rows that satisfy a rule's query
are scanned with its expression.  Rules without mandatory trigrams (a bare run
of hexadecimal digits) scan every text.

All work on rows is built-in functions and joins.

Cases
* null text counts as empty;
* a null id is a key like any other; repeated rows get equal results;
* equal texts under one id share postings, which changes no result;
* extra columns of any name are ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.staging import stage

#: Candidate rows up to which their join broadcasts them (about 30 bytes each); beyond it texts are shuffled.
BROADCAST_CANDIDATES = 200_000


@dataclass(frozen=True)
class Rule:
    """``part`` of a match (0: all) must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1
    base: bool = False


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(["password", "passwd", "secret", "token"])
_KEYWORD = "|".join([*(_either_case(w) for w in _NAMES.split("|")), _either_case("api") + "_?" + _either_case("key")])

RULES: tuple[Rule, ...] = (
    Rule("assign", f"({_KEYWORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True),
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_api", "AIza[0-9A-Za-z_-]{35,}"),
)

#: A trigram query: True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple
_WIDE = 16
_MANY = 64


def _all_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _analysed(nodes) -> tuple[set[str] | None, Query]:
    """The finite set of lower-cased strings a sequence matches (or None), and its query."""
    runs: set[str] = {""}
    query: list[Query] = []
    exact = True
    for op, arg in nodes:
        name = str(op)
        strings: set[str] | None = None
        inner: Query = True
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            strings = _letters(arg)
        elif name == "SUBPATTERN":
            strings, inner = _analysed(arg[3])
        elif name == "BRANCH":
            sides = [_analysed(side) for side in arg[1]]
            if all(s is not None for s, _ in sides):
                strings = set().union(*(s for s, _ in sides))
            inner = _any_of([q if s is None else _all_of([q, _of_strings(s)]) for s, q in sides])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            own, part = _analysed(body)
            if own is not None and high <= 2:
                strings = set()
                for times in range(low, high + 1):
                    grown = {""}
                    for _ in range(times):
                        grown = {a + b for a in grown for b in own}
                    strings |= grown
            elif low:
                inner = part if own is None else _of_strings(own)
        if strings is not None and len(runs) * len(strings) <= _MANY:
            runs = {a + b for a in runs for b in strings}
        else:
            query += [_of_strings(runs), inner if strings is None else _of_strings(strings)]
            runs, exact = ({""}, False) if strings is None or len(strings) > _MANY else (strings, False)
            continue
        query.append(inner)
    if exact:
        return runs, _all_of(query)
    return None, _all_of([*query, _of_strings(runs)])


def _letters(members) -> set[str] | None:
    found: set[str] = set()
    for op, arg in members:
        name = str(op)
        if name == "LITERAL":
            found.add(chr(arg).lower())
        elif name == "RANGE" and arg[1] - arg[0] < _WIDE:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(found) > _WIDE:
            return None
    return found


def trigram_query(pattern: str) -> Query:
    """Boolean query over lower-cased trigrams that every match of ``pattern`` satisfies."""
    strings, query = _analysed(re._parser.parse(pattern))
    return query if strings is None else _all_of([query, _of_strings(strings)])


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def _holds(query: Query, present: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(present, query)
    parts = [_holds(q, present) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it inside ``body``."""
    return F.transform(F.array(value), body)[0]


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index ``(trigram, k_id, k_hash)`` of ``keyed`` texts over ``trigrams``."""
    held = let(F.lower("text"), lambda low: F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(low, t)))
    return keyed.select("k_id", "k_hash", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Intersect postings per row: a Boolean column for each rule with a query."""
    present = index.groupBy("k_id", "k_hash").agg(F.collect_set("trigram").alias("present"))
    return present.select(F.col("k_id").alias("c_id"), F.col("k_hash").alias("c_hash"), *[_holds(q, F.col("present")).alias(f"maybe_{k}") for k, q in queries.items()])


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Matches of a rule, left to right, as ``(start, kind, stop)`` in code points."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.part)).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False))
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(good, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda done: done["spans"])


def _shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def _of_kind(kind: int) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def _found(docs: DataFrame, carry: list[str], id_column: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``row`` (columns ``carry`` as a struct), ``text`` and ``spans`` of all rules, in order."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(id_column).alias("k_id"), F.xxhash64(body).alias("k_hash"), body.alias("text")
    )
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    trigrams = sorted(set().union(*(trigrams_of(q) for q in queries.values())))
    maybe = candidates(postings(keyed, trigrams), queries)
    some = F.lit(False)
    for kind in queries:
        some = some | F.col(f"maybe_{kind}")
    maybe = stage(maybe.filter(some), "op1-candidates")
    few = maybe.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES
    joined = keyed.join(F.broadcast(maybe) if few else maybe, F.col("k_id").eqNullSafe(F.col("c_id")) & (F.col("k_hash") == F.col("c_hash")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    every = [
        F.when(F.col(f"maybe_{r.kind}"), _spans(r, k, F.col("text"))).otherwise(none) if r.kind in queries else _spans(r, k, F.col("text"))
        for k, r in enumerate(rules)
    ]
    return joined.select("row", "text", F.array_sort(F.concat(*every)).alias("spans"))


def scan(docs: DataFrame, *, carry: list[str] | None = None, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets of every row.

    Returns ``row`` (columns ``carry``, all by default), a count ``n_<kind>`` for
    each base rule, ``base_spans`` and ``spans`` as text, ``kind:start:end``
    joined by commas.
    """
    found = _found(docs, carry or docs.columns, id_column, text, rules)
    base = [k for k, r in enumerate(rules) if r.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    return found.select("row", *counts, _shown(own, rules).alias("base_spans"), _shown(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced by ``mark``; texts without one are unchanged."""
    found = _found(docs, docs.columns, id_column, text, rules)

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        gap = F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"]).alias("out"))

    joined = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    cut = found.withColumn("cut", joined)
    clean = F.concat(F.col("cut.out"), F.expr("substring(text, cut.at + 1)"))
    packed = cut.select(F.when(F.size("spans") == 0, F.col("row")[text]).otherwise(clean).alias("clean"), "row")
    return packed.select(*[F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
