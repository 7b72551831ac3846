"""SQL twins of the queries on runs, prefix tries and notices, for DuckDB."""

from __future__ import annotations


def crc32(value: str) -> str:
    """The unsigned CRC-32 of the decimal digits of ``value``, bit by bit."""
    digits = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    step = (
        "list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) FOR z IN range(8)]), "
        "lambda x, z: xor(x // 2, CAST(3988292384 AS BIGINT) * (x % 2)))"
    )
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


WORDS = r"regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')"

RUNS = f"""
WITH h AS (SELECT doc_id, {WORDS} AS w, {crc32('doc_id')} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM h),
a AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM g WHERE h % 10 = 0 AND n > 0),
r AS (SELECT doc_id, n, list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) AS w FROM a
  UNION ALL SELECT doc_id, n, w FROM g WHERE NOT (h % 10 = 0 AND n > 0)),
e AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM r),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
  WHERE 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q) GROUP BY doc_id, q, island),
f AS (SELECT doc_id, s, e, min(q) AS q, e - s AS l FROM s WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l / CAST(q AS DOUBLE) DESC, s, q) AS place FROM f),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS told,
  max(s) FILTER (place = 1) AS s, max(l) FILTER (place = 1) AS l, max(q) FILTER (place = 1) AS q FROM k GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM f),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT r.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM r LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""

TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role,'') AS role, coalesce(text,'') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,'')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
o AS MATERIALIZED (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i < h
  UNION ALL SELECT conv_id, i + 1000000000, role, text FROM c JOIN t USING (conv_id) WHERE i >= h),
p AS (SELECT conv_id, coalesce(w, []) AS w FROM c LEFT JOIN
  (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS w FROM o GROUP BY conv_id) USING (conv_id)),
m AS (SELECT conv_id, len(w) AS n, d, w[1:d] AS path FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM p)),
v AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS childless,
  string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM m GROUP BY path, d),
u AS (SELECT path[1:k] AS path, sum((n_convs - 1) * words) AS saved, count(*) FILTER (childless) AS leaves,
  count(*) FILTER (d = k + 1) AS children
  FROM (SELECT path, d, n_convs, words, childless, unnest(range(0, d + 1)) AS k FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, x.conv_id AS parent_conv_id, v.n_convs, children AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN u USING (path) LEFT JOIN v x ON v.d > 0 AND x.d = v.d - 1 AND x.path = v.path[1:v.d-1]"""


def notices_sql(known) -> str:
    """All spans of whole words within the edits of a notice, by edit distance alone.

    The distance is computed where lengths and counts of letters leave room for it.
    """
    rows = ", ".join(f"('{n.text}', '{n.label}', {n.base}, {n.edits})" for n in known)
    lower = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    letters = "eiotsnrc"
    widest = max(len(n.text.split()) + n.edits for n in known)
    counts = [f"length(replace({{0}}, '{x}', '')) AS {{1}}{x}" for x in letters]
    apart = " + ".join(f"abs(s.length - s.s{x} - k.m + k.k{x})" for x in letters)
    return rf"""
WITH k AS (SELECT *, length(notice) AS m, len(string_split(notice, ' ')) AS nw, {", ".join(c.format("notice", "k") for c in counts)}
  FROM (VALUES {rows}) AS t(notice, label, base, edits)),
w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT DISTINCT m + e AS length, c FROM (SELECT m, unnest(range(-edits, edits + 1)) AS e, unnest AS c
  FROM k, unnest(range(greatest(1, nw - edits), nw + edits + 1)))),
o AS MATERIALIZED (SELECT doc_id, o, w[o+1:o+64+{widest}] AS w, greatest(0, len(w) - o) AS n FROM (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS o FROM w)),
i AS MATERIALIZED (SELECT doc_id, w, n, o, unnest(range(1, least(64, n) + 1)) AS i FROM o),
s AS MATERIALIZED (SELECT *, length(s) AS length, {", ".join(c.format("s", "s") for c in counts)}
  FROM (SELECT doc_id, o + i AS i, c, array_to_string(w[i:i+c-1], ' ') AS s FROM i, (SELECT DISTINCT c FROM c) WHERE i + c - 1 <= n)
  WHERE (length(s), c) IN (SELECT (length, c) FROM c)),
f AS (SELECT doc_id, i - 1 AS i, notice, label, base, m, edits, levenshtein(s.s, notice) AS e
  FROM s JOIN k ON s.length BETWEEN m - edits AND m + edits AND c BETWEEN nw - edits AND nw + edits AND {apart} <= 2 * edits),
d AS (SELECT doc_id, count(*) FILTER (base AND e = 0) AS n_base, min(i) FILTER (base AND e = 0) AS first_word,
  max(i) FILTER (base AND e = 0) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND e = 0) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(1.0::DOUBLE - e / m::DOUBLE) AS score
  FROM f WHERE e <= edits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN d USING (doc_id)"""
