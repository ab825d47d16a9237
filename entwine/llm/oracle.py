"""SQL for DuckDB that gives the rows of the queries which SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EMBEDDINGS = """WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id AND reach.root < link.b)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, min(root) AS component_id, min(root) = vec_id AS kept FROM embeddings JOIN reach ON id = vec_id GROUP BY vec_id"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 10 * c >= 8 * (p.n + q.n - c)),
reach(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id AND reach.root < link.b)
SELECT doc_id, min(root) AS class_id, (SELECT count(*) FROM link WHERE a = doc_id) AS n_links, min(root) = doc_id AS kept FROM documents JOIN reach ON id = doc_id GROUP BY doc_id"""

CHATS = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, rendered FROM c GROUP BY n_turns, rendered)
SELECT conv_id, n_turns, copies, rendered FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.n_turns > u.n_turns AND starts_with(o.rendered, u.rendered))"""


#: The quality rules in the SQL's own words: name, numerator, denominator, least spread in ten-thousandths, whether low values fail too.
QUALITY_RULES = (
    ("symbols", "n_symbols", "word_chars", 100, False),
    ("dup_lines", "n_dup_lines", "n_lines", 1000, False),
    ("repeats", "n_repeat_words", "n_words", 600, False),
    ("shouting", "n_shouts", "word_chars", 400, False),
    ("word_length", "word_chars", "n_words", 3000, True),
)


def quality(weight: int = 50, reach: int = 3) -> str:
    """Counts of whole texts, quartiles in cells of a 64th of the value, fences at `reach` spreads, small groups drawn to larger ones."""
    rows = " UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{n}' AS rule, CASE WHEN {den} > 0 THEN (10000 * {num}) // {den} ELSE 0 END AS v FROM m0" for n, num, den, _, _ in QUALITY_RULES)
    spread = "CASE rule " + " ".join(f"WHEN '{n}' THEN {s}" for n, _, _, s, _ in QUALITY_RULES) + " END"
    low = " OR ".join(f"rule = '{n}'" for n, _, _, _, below in QUALITY_RULES if below)
    mean = lambda x, n, own, above: f"(coalesce({n}, 0) * coalesce({own}.{x}, 0) + {weight} * {above}) // (coalesce({n}, 0) + {weight})"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM (SELECT rid, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d))),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m0 AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[\\p{{Lu}}!]'))::BIGINT AS n_shouts,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN l USING (rid) LEFT JOIN r USING (rid))),
v AS ({rows}),
s AS (SELECT lang, source, rule, v, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)::INT) << (length(bin(v)) - 7)::INT END AS cell FROM v WHERE NOT base_failed),
q1 AS (SELECT lang, source, rule, count(*) AS n, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM s GROUP BY ALL),
q2 AS (SELECT lang, rule, count(*) AS n, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM s GROUP BY ALL),
q3 AS (SELECT rule, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM s GROUP BY ALL),
f2 AS (SELECT k.lang, q3.rule, {mean("q1", "q2.n", "q2", "q3.q1")} AS q1, {mean("q3", "q2.n", "q2", "q3.q3")} AS q3
  FROM (SELECT DISTINCT lang FROM m0) k CROSS JOIN q3 LEFT JOIN q2 ON q2.lang IS NOT DISTINCT FROM k.lang AND q2.rule = q3.rule),
f AS (SELECT lang, source, rule, q3 + {reach} * greatest(q3 - q1, {spread}) AS hi, CASE WHEN {low} THEN q1 - {reach} * greatest(q3 - q1, {spread}) END AS lo
  FROM (SELECT k.lang, k.source, f2.rule, {mean("q1", "q1.n", "q1", "f2.q1")} AS q1, {mean("q3", "q1.n", "q1", "f2.q3")} AS q3
    FROM (SELECT DISTINCT lang, source FROM m0) k JOIN f2 ON f2.lang IS NOT DISTINCT FROM k.lang LEFT JOIN q1 ON q1.lang IS NOT DISTINCT FROM k.lang AND q1.source IS NOT DISTINCT FROM k.source AND q1.rule = f2.rule)),
bad AS (SELECT DISTINCT rid FROM v JOIN f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND f.rule = v.rule WHERE v.v > f.hi OR coalesce(v.v < f.lo, false))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM m0 LEFT JOIN bad USING (rid)"""
