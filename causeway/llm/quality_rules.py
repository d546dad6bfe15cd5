"""Operator 7: quality rules with a robust multivariate outlier test.

Fixed rules reject texts that are too short or repeat themselves.  What passes
is held against its language and source: a minimum-covariance-determinant (MCD)
estimate of four transformed statistics gives every document a Mahalanobis
distance, and far documents are rejected.

Everything is Catalyst expressions and aggregates; no Python runs on executors.
The text is read once.  The statistics are staged, and each concentration step
is one aggregate over them: moments by group, start and cell of a distance grid,
of which the nearest cells up to half of the group are summed.  Steps go on while
a determinant falls; of three starts (medians, lower and upper quartiles) the one
with the least determinant stays.  Rows within the 0.975 quantile then give the
final, reweighted estimate.

Cases
* null or empty text: no words, so ``base_failed``;
* null language or source: a group of its own (null equals null);
* groups under ``MIN_GROUP`` rows are pooled by language, then overall; if even
  the last pool is too small, the method rejects nothing;
* repeated rows are judged one by one and get the same verdict;
* extra columns of any name ride along untouched in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.staging import stage

MIN_WORDS = 50
MIN_GROUP = 50
#: Share of a group that a concentration step keeps.
CORE = 0.5
#: Steps after which concentration raises an error; it ends when no determinant falls, which takes far fewer.
MOST_STEPS = 1_000
#: Fixed values of the chi-squared law with four degrees of freedom: its 0.975 and
#: 0.999 quantiles, and the factors that make the covariance of the nearest half,
#: and of the nearest 0.975, consistent at a normal law (share / P(chi2 of 6 <= quantile)).
NEAR, CUT = 11.1433, 18.467
HALF_FACTOR, NEAR_FACTOR = 2.1091, 1.0645
#: Least standard deviation of each statistic; keeps constant ones invertible.
FLOORS = (0.12, 0.08, 0.12, 0.2)
#: Steps of the logarithmic grid on which distances are ranked, per e-fold.
GRID = 32
#: Steps per unit of the grid on which the first medians and quartiles are found.
START = 250
#: Rows of group estimates up to which the join broadcasts them (about 200 bytes each).
BROADCAST_GROUPS = 50_000
#: Rejected rows up to which their marks are broadcast (16 bytes each).
BROADCAST_REJECTED = 500_000
P = len(FLOORS)
_SPACE = "[ \\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def windows(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        )

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s, lambda x, i: (F.coalesce(F.get(s, i - 1)["k"] == x["k"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)))
            ),
        )
        spread = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(spread))

    return let(
        windows(words),
        lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys)),
    )


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base statistics of ``text`` as one struct column ``stats``."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, _SPACE), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    stats = let(
        words,
        lambda w: let(
            lines,
            lambda rows: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                F.size(rows).cast("long").alias("n_lines"),
                _repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        ),
    )
    return docs.withColumn("stats", stats)


def base_failed() -> Column:
    s = F.col("stats")
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector_sql() -> list[str]:
    """The transformed statistics; SQL text that Spark and DuckDB both read."""
    return [
        "ln(word_chars / cast(n_words as double))",
        "ln(1 + n_symbols / cast(n_words as double))",
        "n_repeat_words / cast(n_words as double)",
        "n_dup_lines / cast(greatest(n_lines, 1) as double)",
    ]


def cholesky_sql() -> list[tuple[str, str]]:
    """Lower triangle ``l_i_j`` of the Cholesky factor of ``c_i_j``, in order of evaluation."""
    out = []
    for i in range(P):
        for j in range(i + 1):
            less = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            out.append((f"l_{i}_{j}", f"sqrt(greatest(c_{i}_{j}{less}, 1e-12))" if i == j else f"(c_{i}_{j}{less}) / l_{j}_{j}"))
    return out


def distance_sql() -> tuple[list[tuple[str, str]], str]:
    """Forward substitution ``z_i`` and the squared Mahalanobis distance."""
    rows = []
    for i in range(P):
        less = "".join(f" - l_{i}_{k} * z_{k}" for k in range(i))
        rows.append((f"z_{i}", f"(x_{i} - m_{i}{less}) / l_{i}_{i}"))
    return rows, " + ".join(f"z_{i} * z_{i}" for i in range(P))


_MOMENTS = [("n_core", "count(*)")] + [(f"s_{i}", f"sum(x_{i})") for i in range(P)] + [(f"q_{i}_{j}", f"sum(x_{i} * x_{j})") for i in range(P) for j in range(i + 1)]
_PLACE = [f"m_{i}" for i in range(P)] + [n for n, _ in cholesky_sql()]


def _estimates(moments: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Location, consistent covariance with floors, its Cholesky factor and log determinant, from sums."""
    out = moments.select("*", *[F.expr(f"s_{i} / n_core").alias(f"m_{i}") for i in range(P)])
    out = out.select(
        *by,
        "n_core",
        *[f"m_{i}" for i in range(P)],
        *[
            F.expr(f"{factor!r}D * (q_{i}_{j} / n_core - m_{i} * m_{j})" + (f" + {FLOORS[i] ** 2!r}D" if i == j else "")).alias(f"c_{i}_{j}")
            for i in range(P)
            for j in range(i + 1)
        ],
    )
    for name, sql in cholesky_sql():
        out = out.withColumn(name, F.expr(sql))
    return out.select(*by, "n_core", *_PLACE, F.expr(" + ".join(f"ln(l_{i}_{i})" for i in range(P))).alias("logdet"))


def _on_group(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join the group table ``b``; broadcast while small, salted when not.

    The group table holds a row per language and source.  Past the bound its rows
    are replicated over salts, so that a hot group is dealt over many tasks.
    """
    b = b.withColumnsRenamed({"g_lang": "b_lang", "g_source": "b_source"})
    same = F.col("g_lang").eqNullSafe(F.col("b_lang")) & F.col("g_source").eqNullSafe(F.col("b_source"))
    if b.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return a.join(F.broadcast(b), same, how).drop("b_lang", "b_source")
    a = a.withColumn("a_salt", F.pmod(F.monotonically_increasing_id(), F.lit(32)).cast("int"))
    b = b.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return a.join(b, same & (F.col("a_salt") == F.col("b_salt")), how).drop("b_lang", "b_source", "a_salt", "b_salt")


def _distances(rows: DataFrame, estimates: DataFrame, how: str = "left") -> DataFrame:
    """Rows, and the start of each estimate if there are several, with ``d2``; groups without estimates get null."""
    joined = _on_group(rows, estimates, how)
    steps, total = distance_sql()
    for name, sql in steps:
        joined = joined.withColumn(name, F.expr(sql))
    start = ["start"] if "start" in estimates.columns else []
    return joined.select(*rows.columns, *start, F.expr(total).alias("d2"))


def _tagged(name: str) -> Column:
    """Text of a key part that keeps null apart from the empty string and from pools."""
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(name)))


def _group_keys(fit: DataFrame) -> DataFrame:
    """Per language and source: the group it belongs to, itself or a pool of small ones."""
    sizes = fit.groupBy("g_lang", "g_source").agg(F.count("*").alias("n_own"))
    pools = sizes.filter(F.col("n_own") < MIN_GROUP).groupBy(F.col("g_lang").alias("p_lang")).agg(F.sum("n_own").alias("n_lang"))
    own, pooled = F.col("n_own") >= MIN_GROUP, F.col("n_lang") >= MIN_GROUP
    return sizes.join(pools, F.col("g_lang").eqNullSafe(F.col("p_lang")), "left").select(
        "g_lang",
        "g_source",
        F.when(own | pooled, _tagged("g_lang")).otherwise("*").alias("k_lang"),
        F.when(own, _tagged("g_source")).otherwise("*").alias("k_source"),
    )


def _grouped(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Replace language and source by the group key; pairs without good rows go to the last pool."""
    out = _on_group(rows, keys, "left")
    other = [c for c in rows.columns if c not in ("g_lang", "g_source")]
    return out.select(*other, F.coalesce("k_lang", F.lit("*")).alias("g_lang"), F.coalesce("k_source", F.lit("*")).alias("g_source"))


def _first_estimates(vectors: DataFrame) -> DataFrame:
    """Three starts: medians and quartiles on a grid of ``START`` steps per unit, with spreads from the quartiles."""
    long = vectors.select("g_lang", "g_source", F.posexplode(F.array(*[f"x_{i}" for i in range(P)])).alias("i", "x"))
    cells = long.groupBy("g_lang", "g_source", "i", F.floor(F.col("x") * START).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    ranked = cells.selectExpr(
        "g_lang", "g_source", "i", "cell", "sum(n) over (partition by g_lang, g_source, i order by cell) as reached", "sum(n) over (partition by g_lang, g_source, i) as whole"
    )
    parts = {"mid": 0.5, "low": 0.25, "high": 0.75}
    quart = ranked.groupBy("g_lang", "g_source", "i").agg(*[F.min(F.when(F.col("reached") >= share * F.col("whole"), F.col("cell"))).alias(name) for name, share in parts.items()])
    wide = quart.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("i") == i, (F.col(name) + 0.5) / START)).alias(f"{name}_{i}") for i in range(P) for name in parts])

    def spread(i: int) -> Column:
        return F.sqrt(F.pow((F.col(f"high_{i}") - F.col(f"low_{i}")) / 1.349, 2) + FLOORS[i] ** 2)

    starts = [
        F.struct(
            F.lit(k).alias("start"),
            *[F.col(f"{name}_{i}").alias(f"m_{i}") for i in range(P)],
            *[(spread(i) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(P) for j in range(i + 1)],
        )
        for k, name in enumerate(parts)
    ]
    return wide.select("g_lang", "g_source", F.inline(F.array(*starts))).withColumns({"n_core": F.lit(0).cast("long"), "logdet": F.lit(1e300)})


def _concentrate(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """One C-step of every start; one whose determinant does not fall stays as it is, with ``moved`` false.

    Distances are ranked on a logarithmic grid by counting, so that no group is
    sorted or gathered; all rows of the last grid cell are kept.
    """
    by = ["g_lang", "g_source", "start"]
    near = _distances(vectors, estimates, "inner").withColumn("cell", F.floor(F.log(F.col("d2") + 1e-6) * GRID).cast("int"))
    cells = near.groupBy(*by, "cell").agg(*[F.expr(sql).alias(name) for name, sql in _MOMENTS])
    ranked = cells.selectExpr(
        "*", "sum(n_core) over (partition by g_lang, g_source, start order by cell) as reached", "sum(n_core) over (partition by g_lang, g_source, start) as whole"
    )
    core = ranked.filter(F.col("reached") - F.col("n_core") < CORE * F.col("whole")).groupBy(*by).agg(*[F.sum(name).alias(name) for name, _ in _MOMENTS])
    new = _estimates(core, by, HALF_FACTOR).select(*by, F.struct("n_core", *_PLACE, "logdet").alias("new"))
    old = estimates.select(*by, F.struct("n_core", *_PLACE, "logdet").alias("old"))
    fell = F.col("new.logdet") < F.col("old.logdet") - 1e-9
    kept = old.join(new, by).select(*by, F.when(fell, F.col("new")).otherwise(F.col("old")).alias("best"), fell.alias("moved"))
    return stage(kept.select(*by, "best.*", "moved"), "op7-step")


def mcd_estimates(vectors: DataFrame) -> DataFrame:
    """MCD location and Cholesky factor per group, for ``vectors(g_lang, g_source, x_*)``."""
    estimates = stage(_first_estimates(vectors), "op7-start")
    for _ in range(MOST_STEPS):
        stepped = _concentrate(vectors, estimates)
        estimates = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"a determinant still falls after {MOST_STEPS} concentration steps")
    least = estimates.groupBy("g_lang", "g_source").agg(F.min(F.struct("logdet", "start", *_PLACE)).alias("best")).select("g_lang", "g_source", *[F.col(f"best.{c}").alias(c) for c in _PLACE])
    near = _distances(vectors, stage(least, "op7-least"), "inner").filter(F.col("d2") <= NEAR)
    moments = near.groupBy("g_lang", "g_source").agg(*[F.expr(sql).alias(name) for name, sql in _MOMENTS])
    return stage(_estimates(moments, ["g_lang", "g_source"], NEAR_FACTOR), "op7-final").filter(F.col("n_core") >= CORE * MIN_GROUP)


def quality_verdicts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", cut: float = CUT, carry: list[str] | None = None) -> DataFrame:
    """Statistics and verdict of every row.

    Returns ``row`` (the columns ``carry`` of ``docs``, all by default, as a
    struct), ``stats``, ``base_failed``, ``distance2`` (null where the rules
    already reject or the group is too small) and ``kept``.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row"),
        F.col(text).alias("t"),
        F.col(lang).cast("string").alias("g_lang"),
        F.col(source).cast("string").alias("g_source"),
    )
    measured = stage(base_statistics(packed, "t").drop("t"), "op7-rows")
    rows = measured.withColumn("base_failed", base_failed())
    flat = (
        rows.select("row", "stats", "base_failed", "g_lang", "g_source", "stats.*")
        .select("row", "stats", "base_failed", "g_lang", "g_source", *[F.when(~F.col("base_failed"), F.expr(sql)).alias(f"x_{i}") for i, sql in enumerate(vector_sql())])
    )
    fit = flat.filter(~F.col("base_failed")).select("g_lang", "g_source", *[f"x_{i}" for i in range(P)])
    keys = stage(_group_keys(fit), "op7-groups")
    estimates = mcd_estimates(stage(_grouped(fit, keys), "op7-vectors"))
    judged = _distances(_grouped(flat, keys), estimates)
    return judged.select(
        "row",
        "stats",
        "base_failed",
        F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"),
        (~F.col("base_failed") & ~F.coalesce(F.col("d2") > cut, F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``.

    A verdict depends on text, language and source alone, so rejected rows are
    named by two hashes of these, and whole rows are neither staged nor measured twice.
    """
    held = [c for name in (text, lang, source) for c in (F.col(name).isNull(), F.col(name).cast("string"))]
    marks = {f"mark_{k}": F.xxhash64(F.lit(k), *held) for k in (1, 2)}
    marked = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"), *[c.alias(n) for n, c in marks.items()])
    bad = quality_verdicts(marked, carry=list(marks), **options).filter("not kept").select("row.*").distinct()
    bad = stage(bad, "op7-rejected")
    few = bad.limit(BROADCAST_REJECTED + 1).count() <= BROADCAST_REJECTED
    packed = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in marks.items()])
    return packed.join(F.broadcast(bad) if few else bad, list(marks), "left_anti").select("row.*")
