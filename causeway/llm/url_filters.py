"""Operator 6: URL filters, rules first and a logistic regression for the rest.

Host and path are cut into character n-grams, hashed into ``FEATURES`` slots.  A
logistic regression over the slots is trained from a small labelled table of
URLs; where no rule fits, it gives the verdict.

Rows are scored with built-in functions only; the trained weights are a literal
array of fixed length.

Cases
* a null url, or one without ``://``, has an empty host and path; no rule fits it
  and the method judges it by its intercept;
* of rules that fit, the longest wins; among equally long ones the first in text order;
* repeated rows get equal results; extra columns of any name are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 32768
SIZES = (3, 4, 5)
RIDGE = 0.0005
#: What an unwanted row counts against an ordinary one, of which there are more.
BLOCKED_WEIGHT = 4.0


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

# Words of unwanted and of ordinary hosts by topic, words that go with
# either, and syllables of names that mean nothing to the model.
UNWANTED = """
casino poker slots roulette jackpot betting bets gambling lottery bingo wager blackjack
porn xxx adult sex nude escort erotic webcam hookup fetish
viagra cialis pills pharmacy-deals steroids slimming miracle-cure
spam backlinks linkfarm bulkmail traffic-bot seo-blast mass-mailer
malware phishing trojan keygen crack warez serialz ransom botnet
payday quickloan get-rich forex-profit crypto-doubler giveaway prizes survey-cash
replica counterfeit fake-id knockoff
adserver popup-ads ads clicks tracker banner-ads doubleclicks
""".split()
ORDINARY = """
herald gazette times weather radio news magazine press bulletin journal
garden cooking recipes travel photo books knitting hiking woodwork museum
university physics library school institute academy history mathematics chemistry biology
software wiki forum manual data code developer database algorithms statistics
hospital clinic health council parliament ministry police court embassy station
shoes bakery hotel railway bank insurance furniture bicycles restaurant market
orchestra theatre cinema gallery choir film poetry novels opera dance
football swimming chess athletics rowing tennis sailing cycling skating climbing
geology birds river forest ocean butterfly mountain island valley coast
zeitung strasse rathaus maison mairie jardin ciudad mercado escuela biblioteca
""".split()
EITHER = "online club best new my city live top world info now pro center home direct plus daily first point group".split()
SYLLABLES = "an ba be bra co da de dor el en er est fa fi fra ga ge go ha he hel in ion ka ke kla la le li lo ma me mi mon na ne ni no nor on or ou pa pe po ra re ri ro sa se si sta ta te ter th the ti to tre tri ul un ur va ve vi wa we wi za ze".split()
ENDINGS = ("com", "org", "net", "info", "test", "co.uk", "de", "fr", "example.com", "example.org")
PATHS = ("/", "/index.html", "/en/{k}", "/de/{k}.html", "/fr/{k}/", "/es/{k}", "/p/{k}", "/{k}", "/page/{k}.html", "/about", "/a/b/{k}")
#: Rows of names without meaning, all ordinary; so a host is not unwanted for want of known words.
NAMES = 900


def _pick(values: Sequence[str], *keys: object) -> str:
    """One of ``values``, chosen by a checksum of the keys."""
    return values[zlib.crc32(repr(keys).encode()) % len(values)]


def _url(stem: str, k: int) -> str:
    front = _pick(("", "", "", "www.", "m.", "blog."), "front", stem, k)
    return f"http://{front}{stem}.{_pick(ENDINGS, 'end', stem, k)}{_pick(PATHS, 'path', stem, k).format(k=zlib.crc32(f'{stem}{k}'.encode()) % 1000)}"


def _stems(word: str) -> list[str]:
    """Host names with a word: alone, and with words and syllables that go with anything."""
    shapes = ("{w}", "{h}-{w}", "{w}-{h}", "{w}{h}", "{h}{w}", "{w}-{n}", "{n}-{w}", "{w}{n}", "{h}-{w}-{n}", "{n}-{w}-{h}")
    return [shape.format(w=word, h=_pick(EITHER, word, k), n=_pick(SYLLABLES, word, k) + _pick(SYLLABLES, k, word)) for k, shape in enumerate(shapes)]


def labelled_urls() -> list[tuple[str, bool, str]]:
    """The labelled table by rule: URL, whether it is unwanted, and the word it was made of."""
    rows = [(_url(stem, k), blocked, word) for words, blocked in ((UNWANTED, True), (ORDINARY, False)) for word in words for k, stem in enumerate(_stems(word))]
    for k in range(NAMES):
        name = "".join(_pick(SYLLABLES, "name", k, i) for i in range(2 + k % 3))
        stem = name if k % 4 else f"{name}-{''.join(_pick(SYLLABLES, 'second', k, i) for i in range(2))}"
        rows.append((_url(stem, k), False, f"name {k}"))
    rows += [(_url(f"{_pick(EITHER, 'one', k)}-{_pick(EITHER, 'two', k)}", k), False, f"either {k}") for k in range(60)]
    return rows


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path of a URL; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(text, pattern, 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(text, pattern, 2)


def slots(host: Column, path: Column) -> Column:
    """Distinct hashed character n-grams of host and path."""

    def of(text: Column, salt: int) -> Column:
        marked = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

        def runs(chars: Column, size: int) -> Column:
            return F.when(F.size(chars) < size, F.array().cast("array<bigint>")).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(chars) - size),
                    lambda i: F.pmod(F.xxhash64(F.lit(salt), *[F.get(chars, i + k) for k in range(size)]), F.lit(FEATURES)),
                )
            )

        letters = F.array_remove(marked, "")
        return F.transform(F.array(letters), lambda chars: F.concat(*[runs(chars, size) for size in SIZES]))[0]

    return F.array_distinct(F.concat(of(host, 1), of(path, 2)))


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table ``(url, blocked)``."""
    return spark.createDataFrame([(url, float(blocked)) for url, blocked, _ in labelled_urls()], "url string, blocked double")


def train(table: DataFrame) -> tuple[list[float], float]:
    """Weights of the slots and intercept, from ``table(url, blocked)`` of at most thousands of rows."""
    host, path = parts(F.col("url"))
    weight = F.when(F.col("blocked") == 1, F.lit(BLOCKED_WEIGHT)).otherwise(F.lit(1.0))
    own = table.select(slots(host, path).cast("array<string>").alias("slots"), F.col("blocked").alias("label"), weight.alias("weight")).coalesce(1)
    places = CountVectorizerModel.from_vocabulary([str(k) for k in range(FEATURES)], inputCol="slots", outputCol="features")
    model = LogisticRegression(regParam=RIDGE, standardization=False, maxIter=80, tol=1e-6, weightCol="weight").fit(places.setBinary(True).transform(own))
    return [round(float(w), 4) for w in model.coefficients.toArray()], float(model.intercept)


def logit(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    sent = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    return F.aggregate(slots(host, path), F.lit(intercept), lambda total, i: total + F.get(sent, i.cast("int")))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(pages: DataFrame, *, id_column: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, the longest fitting ``rule`` and its ``verdict``; both null if none fits."""
    host, path = parts(F.col(url))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = _fits(r, F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, *, id_column: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, table: DataFrame | None = None) -> DataFrame:
    """Verdict of every row: ``page_id``, ``host``, ``path``, ``rule``, ``block_logit`` and ``verdict``."""
    weights, intercept = train(labelled(pages.sparkSession) if table is None else table)
    scored = ruled(pages, id_column=id_column, url=url, rules=rules).withColumn("block_logit", logit(F.col("host"), F.col("path"), weights, intercept))
    own = F.when(F.col("block_logit") >= 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", "block_logit", F.coalesce("verdict", own).alias("verdict"))
