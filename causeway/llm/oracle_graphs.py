"""DuckDB SQL for the trie, the spelling variants and the vector links, written apart from the operators."""

from __future__ import annotations

#: The table of CRC-32, from its polynomial.
_TABLE = """tab AS (
    SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, c FROM steps WHERE k = 8)
)"""
_STEPS = """steps(i, k, c) AS (
    SELECT i, 0, i FROM range(256) AS r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
)"""


def _crc(listed: str) -> str:
    """CRC-32 of a list of bytes, with the table ``tab`` in reach."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {listed}), lambda acc, b: xor(acc >> 8, tab[(xor(acc, b) & 255) + 1])), 4294967295)"


TRIE = f"""
WITH RECURSIVE {_STEPS}, {_TABLE},
ranked AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT c, {_crc("list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 4 AS h FROM (SELECT DISTINCT c FROM ranked), tab
),
taken AS (SELECT convs.c, r, role, text FROM convs JOIN ranked ON ranked.c = convs.c - convs.c % 20 AND r <= h),
numbered AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, r) AS d, role, text FROM (
        SELECT c, 0 AS own, r, role, text FROM taken
        UNION ALL SELECT c, 1, r, role, text FROM ranked JOIN convs USING (c) WHERE r > h)
),
prefixes AS (
    SELECT c, d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS node, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM numbered
    UNION ALL SELECT c, 0, '', 0 FROM convs
),
sized AS (SELECT *, max(d) OVER (PARTITION BY c) AS size FROM prefixes),
nodes AS (
    SELECT node, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, max(words) AS words,
        sha256(coalesce(string_agg(CASE WHEN d = size THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
    FROM sized GROUP BY node
),
families AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes AS k WHERE k.depth = n.depth + 1 AND starts_with(k.node, n.node)) AS n_children
    FROM nodes AS n LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND starts_with(n.node, p.node)
)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, sum((u.n_children = 0)::INT)::BIGINT AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens, v.ends_sha256
FROM families AS v JOIN families AS u ON starts_with(u.node, v.node)
GROUP BY ALL
"""
VARIANTS = f"""
WITH RECURSIVE {_STEPS}, {_TABLE},
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
),
hashed AS (
    SELECT run, n, {_crc("list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda p: ('0x' || p)::BIGINT)")} AS h FROM runs, tab WHERE length(run) >= 7
),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged GROUP BY word HAVING sum(n) >= 2 AND length(word) >= 7),
holes AS (
    SELECT word, n, k, left(word, k - 1) AS head, substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
),
pairs AS (
    SELECT a.word AS a, b.word AS b FROM holes AS a JOIN holes AS b ON a.head = b.head AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT word, w FROM holes JOIN (SELECT word AS w FROM words) ON w = head || rest
    UNION SELECT w, word FROM holes JOIN (SELECT word AS w FROM words) ON w = head || rest
),
near AS (
    SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS best_n FROM pairs JOIN words ON words.word = b GROUP BY a
),
forms AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM words LEFT JOIN near USING (word)
),
chain(word, tip) AS (
    SELECT word, word FROM forms
    UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = tip WHERE form IS NOT NULL
)
SELECT forms.word, forms.form, tips.tip AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN (SELECT chain.word, tip FROM chain JOIN forms ON forms.word = tip WHERE form IS NULL) AS tips USING (word)
"""
LINKS = """
WITH RECURSIVE vectors AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
usable AS (SELECT * FROM vectors WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, component_id = v.vec_id AS kept
FROM vectors AS v JOIN least USING (vec_id)
"""
