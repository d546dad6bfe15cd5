"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from causeway.llm import oracle_graphs, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(k: int, rule: secrets.Rule) -> str:
    """Spans of one rule: text between matches and matches in turn give the places."""
    pattern = _quoted(rule.pattern)
    return f"""SELECT rid, {k} AS kind, start, start + length(hit) AS stop, part FROM (
      SELECT rid, hits[i] AS hit, parts[i] AS part, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT rid, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT rid, regexp_extract_all(body, {pattern}, 0) AS hits, regexp_extract_all(body, {pattern}, {rule.part}) AS parts, string_split_regex(body, {pattern}) AS gaps FROM docs)))
    WHERE length(part) >= {rule.least}"""


def _secret_sql() -> str:
    kinds = "[" + ", ".join(_quoted(r.kind) for r in secrets.RULES) + "]"
    base = ", ".join(str(k) for k, r in enumerate(secrets.RULES) if r.base)
    shown = f"string_agg({kinds}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
  found AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(secrets.RULES))}),
  told AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, {shown} FILTER (kind IN ({base})) AS base, {shown} AS spans FROM found GROUP BY rid)
  SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told ON docs.rid = told.rid"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTAMINATION = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
  items AS MATERIALIZED (SELECT cast(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
  wins AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
  spots AS (SELECT rid, s.n AS n, i, array_to_string(w[i:i + s.n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM wins) WHERE len(w) >= n) s),
  hits AS MATERIALIZED (SELECT rid, i, spots.n AS n, item FROM spots JOIN wins ON spots.win = wins.win AND spots.n = wins.n),
  cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
  which AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs LEFT JOIN cover ON docs.rid = cover.rid LEFT JOIN which ON docs.rid = which.rid"""

_WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM f"""


#: Concentration steps of the SQL, more than the given tables need.
_STEPS = 20


def _rules_sql() -> str:
    """The quality rules, their statistics, three starts, concentration steps, reweighting and cut; a step after the last fall changes nothing, so any number from there on gives the same."""
    n = range(4)
    floors = (0.0144, 0.0064, 0.0144, 0.04)  # squares of the least standard deviations

    def inverse_by_rows(rows: str) -> str:
        """Factor c = L L' column by column, one nested query per entry that others use."""
        out = rows
        for i in n:
            for j in range(i + 1):
                done = "".join(f" - f{i}{k} * f{j}{k}" for k in range(j))
                out = f"SELECT *, {f'sqrt(greatest(v{i}{i}{done}, 1e-12))' if i == j else f'(v{i}{j}{done}) / f{j}{j}'} AS f{i}{j} FROM ({out})"
        return f"SELECT *, ln(f00) + ln(f11) + ln(f22) + ln(f33) AS det FROM ({out})"

    def spread(rows: str, by: str, factor: str) -> str:
        sums = ", ".join([*(f"sum(x{i}) AS s{i}" for i in n), *(f"sum(x{i} * x{j}) AS s{i}{j}" for i in n for j in range(i + 1))])
        cov = ", ".join(f"{factor} * (s{i}{j} / m - (s{i} / m) * (s{j} / m))" + (f" + {floors[i]}::DOUBLE" if i == j else "") + f" AS v{i}{j}" for i in n for j in range(i + 1))
        return inverse_by_rows(f"SELECT {by}, m, {', '.join(f's{i} / m AS u{i}' for i in n)}, {cov} FROM (SELECT {by}, count(*) AS m, {sums} FROM {rows} GROUP BY ALL)")

    place = ", ".join([*(f"u{i}" for i in n), *(f"f{i}{j}" for i in n for j in range(i + 1))])

    def far(rows: str, estimates: str, start: str, how: str) -> str:
        out = f"SELECT r.*{start}, e.* EXCLUDE (gl, gs{', st' if start else ''}) FROM {rows} r {how} JOIN {estimates} e ON r.gl = e.gl AND r.gs = e.gs"
        for i in n:
            out = f"SELECT *, (x{i} - u{i}{''.join(f' - f{i}{k} * y{k}' for k in range(i))}) / f{i}{i} AS y{i} FROM ({out})"
        return f"SELECT *, y0 * y0 + y1 * y1 + y2 * y2 + y3 * y3 AS dd FROM ({out})"

    parts = [
        r"docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)",
        "tri AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs))",
        "rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, t) AS k FROM tri) WHERE k > 1) GROUP BY rid)",
        r"lin AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT rid, unnest(string_split(body, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid)",
        "st AS MATERIALIZED (SELECT docs.rid AS rid, doc_id, lang, source, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words "
        "FROM docs LEFT JOIN lin ON docs.rid = lin.rid LEFT JOIN rep ON docs.rid = rep.rid)",
        "vc AS MATERIALIZED (SELECT *, CASE WHEN NOT base_failed THEN ln(word_chars / n_words::DOUBLE) END AS x0, CASE WHEN NOT base_failed THEN ln(1 + n_symbols / n_words::DOUBLE) END AS x1, "
        "CASE WHEN NOT base_failed THEN n_repeat_words / n_words::DOUBLE END AS x2, CASE WHEN NOT base_failed THEN n_dup_lines / greatest(n_lines, 1)::DOUBLE END AS x3 "
        "FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM st))",
        "sz AS MATERIALIZED (SELECT lang, source, count(*) AS n FROM vc WHERE NOT base_failed GROUP BY 1, 2)",
        "pl AS (SELECT lang, sum(n) AS n_lang FROM sz WHERE n < 50 GROUP BY 1)",
        "ky AS MATERIALIZED (SELECT sz.lang AS lang, source, CASE WHEN n >= 50 OR n_lang >= 50 THEN coalesce('=' || sz.lang, 'null') ELSE '*' END AS gl, CASE WHEN n >= 50 THEN coalesce('=' || source, 'null') ELSE '*' END AS gs "
        "FROM sz LEFT JOIN pl ON sz.lang IS NOT DISTINCT FROM pl.lang)",
        "gr AS MATERIALIZED (SELECT vc.* EXCLUDE (lang, source), coalesce(gl, '*') AS gl, coalesce(gs, '*') AS gs FROM vc LEFT JOIN ky ON vc.lang IS NOT DISTINCT FROM ky.lang AND vc.source IS NOT DISTINCT FROM ky.source)",
        "ft AS MATERIALIZED (SELECT gl, gs, x0, x1, x2, x3 FROM gr WHERE NOT base_failed)",
        "hs AS (SELECT gl, gs, i, cell, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT gl, gs, {i} AS i, floor(x{i} * 250)::INTEGER AS cell FROM ft" for i in n) + ") GROUP BY ALL)",
        "rk AS (SELECT *, sum(n) OVER (PARTITION BY gl, gs, i ORDER BY cell) AS reached, sum(n) OVER (PARTITION BY gl, gs, i) AS whole FROM hs)",
        "qt AS MATERIALIZED (SELECT gl, gs, i, (min(cell) FILTER (reached >= 0.25 * whole) + 0.5e0) / 250 AS q1, (min(cell) FILTER (reached >= 0.5 * whole) + 0.5e0) / 250 AS q2, (min(cell) FILTER (reached >= 0.75 * whole) + 0.5e0) / 250 AS q3 FROM rk GROUP BY ALL)",
        "e0 AS MATERIALIZED ("
        + " UNION ALL ".join(
            f"SELECT gl, gs, {s} AS st, 0 AS m, {', '.join(f'max({q}) FILTER (i = {i}) AS u{i}' for i in n)}, "
            + ", ".join(f"sqrt(pow((max(q3) FILTER (i = {i}) - max(q1) FILTER (i = {i})) / 1.349e0, 2) + {floors[i]}::DOUBLE) AS f{i}{j}" if i == j else f"0e0 AS f{i}{j}" for i in n for j in range(i + 1))
            + ", 1e300 AS det FROM qt GROUP BY gl, gs"
            for s, q in enumerate(("q2", "q1", "q3"))
        )
        + ")",
    ]
    for k in range(_STEPS):
        parts += [
            f"d{k} AS MATERIALIZED (SELECT *, floor(ln(dd + 1e-6) * 32)::INTEGER AS cell FROM ({far('ft', f'e{k}', ', e.st', 'INNER')}))",
            f"k{k} AS MATERIALIZED (SELECT gl, gs, st, min(cell) AS last FROM (SELECT *, sum(n) OVER (PARTITION BY gl, gs, st ORDER BY cell) AS reached, sum(n) OVER (PARTITION BY gl, gs, st) AS whole FROM (SELECT gl, gs, st, cell, count(*) AS n FROM d{k} GROUP BY ALL)) WHERE reached >= 0.5 * whole GROUP BY ALL)",
            f"n{k} AS MATERIALIZED ({spread(f'(SELECT d.gl, d.gs, d.st, x0, x1, x2, x3 FROM d{k} d JOIN k{k} k ON d.gl = k.gl AND d.gs = k.gs AND d.st = k.st WHERE cell <= last)', 'gl, gs, st', '2.1091e0')})",
            f"e{k + 1} AS MATERIALIZED (SELECT o.gl, o.gs, o.st, {', '.join(f'CASE WHEN w.det < o.det - 1e-9 THEN w.{c} ELSE o.{c} END AS {c}' for c in ('m, ' + place + ', det').split(', '))} FROM e{k} o JOIN n{k} w ON o.gl = w.gl AND o.gs = w.gs AND o.st = w.st)",
        ]
    parts += [
        f"be AS MATERIALIZED (SELECT gl, gs, {place} FROM (SELECT *, row_number() OVER (PARTITION BY gl, gs ORDER BY det, st) AS k FROM e{_STEPS}) WHERE k = 1)",
        f"nr AS MATERIALIZED (SELECT gl, gs, x0, x1, x2, x3 FROM ({far('ft', 'be', '', 'INNER')}) WHERE dd <= 11.1433)",
        f"fi AS MATERIALIZED (SELECT gl, gs, {place} FROM ({spread('nr', 'gl, gs', '1.0645e0')}) WHERE m >= 25)",
    ]
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(dd > 18.467, false) AS kept FROM ({far('gr', 'fi', '', 'LEFT')})"


_URL_RULES = rf"""WITH u AS (SELECT page_id, instr(coalesce(url, ''), '://') AS k, coalesce(url, '') AS url FROM pages),
  v AS (SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM u),
  h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM v),
  f AS (SELECT *, '.' || host AS dotted FROM h)
  SELECT page_id, host, path,
    CASE WHEN dotted LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN dotted LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN dotted LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN dotted LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN dotted LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'allow' WHEN dotted LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'block'
         WHEN dotted LIKE '%.org' AND starts_with(path, '/fr/') THEN 'allow' WHEN dotted LIKE '%.net' AND starts_with(path, '/') THEN 'block' END AS verdict FROM f"""

ORACLES: dict[str, str] = {
    "url_rules": _URL_RULES,
    "op1_secret_scans": _secret_sql(),
    "op2_decontamination": _CONTAMINATION,
    "op5_warc": _WARC,
    "op7_quality_rules": _rules_sql(),
    "op11_conversation_trie": oracle_graphs.TRIE,
    "op12_spelling_variants": oracle_graphs.VARIANTS,
    "op13_embedding_duplicates": oracle_graphs.LINKS,
}
