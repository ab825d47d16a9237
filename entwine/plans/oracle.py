"""SQL for DuckDB that says the same as the registered queries, built from the same fixed values."""

from __future__ import annotations

from ..functions import text as t
from ..operators import canonical as c
from ..operators.channels import ADDRESS_STOP_WORDS


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words_list(xs) -> str:
    return "(" + ", ".join(map(quote, xs)) + ")"


def tokens(x: str, kept: str = "a-z0-9") -> str:
    return f"list_filter(string_split(regexp_replace({x}, '[^{kept}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def edges(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ,.-/')"


def doubles(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


def fold_token(w: str) -> str:
    x = w
    for a, b in t.VOWEL_FOLDS:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    x = doubles(x)
    for a, b in (*t.ASPIRATE_FOLDS, *t.CONSONANT_FOLDS):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace({x}, '^(.{{2,}}[^aeiou])a$', '\\1')"
    x = f"regexp_replace({x}, 'y$', 'i')"
    return f"CASE WHEN length({w}) <= 1 THEN {w} ELSE {doubles(x)} END"


def word_letters(x: str) -> str:
    """The text with letters and digits beyond ASCII as `_`, which a word boundary here takes for a letter, and other signs beyond it as `~`."""
    return f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7f\\p{{L}}\\p{{N}}]', '~', 'g'), '[^\\x00-\\x7f]', '_', 'g')"


def case(x: str, pairs, other: str) -> str:
    return f"CASE {' '.join(f'WHEN {x} = {quote(a)} THEN {quote(b)}' for a, b in pairs)} ELSE {other} END"


def legal_case() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(p5, {quote(p)}) THEN {quote(n)}" for p, n in t.LEGAL_FORMS) + " ELSE '' END"


def legal_removed() -> str:
    return "CASE " + " ".join(f"WHEN legal_form = {quote(n)} THEN regexp_replace(p5, {quote(p)}, ' ', 'g')" for p, n in t.LEGAL_FORMS) + " ELSE p5 END"


VIEW = r"""view_raw AS (
  SELECT 'S' || (page_id % 3 + 1) || '-' || page_id AS entity_id, 'S' || (page_id % 3 + 1) AS source, page_id AS row_ord,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS business_name,
    regexp_extract(url, '/([0-9]+)', 1) || ' ' || replace(regexp_replace(url, '^[a-z]+://', ''), '/', ', ') AS business_address,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS country, html
  FROM pages)"""


def _marks() -> str:
    out = []
    for i, mark in enumerate(t.ALIAS_MARKS):
        hit, whole = quote(mark), quote("(?s)^(.*?)" + mark)
        out.append(f"""a{i + 2} AS (SELECT * EXCLUDE (p{i + 1}, l{i + 1}),
    CASE WHEN regexp_matches(p{i + 1}, {hit}) THEN trim(regexp_extract(p{i + 1}, {whole}, 1)) ELSE p{i + 1} END AS p{i + 2},
    CASE WHEN regexp_matches(p{i + 1}, {hit}) AND length(trim(regexp_extract(p{i + 1}, {hit}, 1))) >= 2 THEN list_append(l{i + 1}, trim(regexp_extract(p{i + 1}, {hit}, 1))) ELSE l{i + 1} END AS l{i + 2} FROM a{i + 1})""")
    return ",\n".join(out)


DOMAIN = t.DOMAIN.replace(r"(?=[/\s]|$)", r"([/\s]|$)")
LOW = "trim(" + word_letters("lower(business_name)") + ")"
RECORDS = f"""{VIEW},
a0 AS (SELECT *, replace(replace(replace({LOW}, '&', ' and '), '+', ' and '), '@', ' at ') AS n, trim({word_letters('lower(business_address)')}) AS addr FROM view_raw),
a1 AS (SELECT *, regexp_replace(n, '\\([^)]*\\)', ' ', 'g') AS p1, list_filter(list_transform(regexp_extract_all(n, '\\(([^)]+)\\)', 1), lambda x: trim(x)), lambda x: length(x) >= 2) AS l1 FROM a0),
{_marks()},
a5 AS (SELECT * EXCLUDE (p4, l4), {edges('p4')} AS q, l4 FROM a4),
a6 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(q, 'https?://', '', 'g'), '\\bwww\\.', '', 'g'), {quote(DOMAIN)}, '\\1', 'g')) AS sh,
  list_filter(list_transform(l4, lambda x: {edges('x')}), lambda x: x <> '' AND x <> q) AS l5 FROM a5),
a7 AS (SELECT *, CASE WHEN sh <> '' AND sh <> q THEN sh ELSE q END AS p5, CASE WHEN sh <> '' AND sh <> q THEN list_append(l5, sh) ELSE l5 END AS l6 FROM a6),
a8 AS (SELECT *, {legal_case()} AS legal_form FROM a7),
a9 AS (SELECT *, {edges(legal_removed())} AS core0 FROM a8),
a10 AS (SELECT *, {tokens('n')} AS all_t, {tokens('core0')} AS raw0 FROM a9),
a11 AS (SELECT *, list_filter(all_t, lambda w, i: i = 1 OR w <> all_t[i - 1]) AS name_tokens, list_filter(raw0, lambda w, i: i = 1 OR w <> raw0[i - 1]) AS raw1 FROM a10),
a12 AS (SELECT *, list_filter(raw1, lambda w: w NOT IN {words_list(t.NAME_STOP_WORDS)}) AS mean FROM a11),
a13 AS (SELECT *, CASE WHEN len(mean) > 0 THEN mean ELSE raw1 END AS name_core_tokens FROM a12),
a14 AS (SELECT *, array_to_string(name_tokens, ' ') AS name_norm, array_to_string(name_core_tokens, ' ') AS name_core, array_to_string(name_core_tokens, '') AS name_clean,
  CASE WHEN len(name_core_tokens) < 2 THEN '' ELSE array_to_string(list_transform(name_core_tokens, lambda w: w[1]), '') END AS name_acronym,
  array_to_string(list_transform(name_core_tokens, lambda w: {fold_token('w')}), ' ') AS name_fold,
  list_filter(list_transform(l6, lambda a: array_to_string({tokens('a')}, ' ')), lambda a: a <> '' AND a <> array_to_string(all_t, ' ')) AS name_alts FROM a13),
b1 AS (SELECT *, list_filter(list_transform(string_split(addr, ','), lambda s: trim(s)), lambda s: s <> '') AS segs,
  trim(regexp_extract(addr, {quote(t.LANDMARK)}, 1)) AS landmark,
  CASE WHEN regexp_matches(addr, {quote(t.LANDMARK)}) THEN {edges("regexp_replace(addr, " + quote(t.LANDMARK) + ", ' ')")} ELSE addr END AS plain FROM a14),
b2 AS (SELECT *, trim(regexp_replace(CASE WHEN len(segs) = 0 THEN '' WHEN len(segs) = 1 THEN segs[1] ELSE segs[-2] || ' ' || segs[-1] END, '[^a-z0-9]+', ' ', 'g')) AS addr_tail,
  coalesce(nullif(regexp_extract(business_address, '\\b(\\d{{5}})-\\d{{4}}\\b', 1), ''), regexp_extract_all(business_address, '\\b\\d{{5,6}}\\b')[-1], regexp_extract_all(business_address, '\\b\\d{{4}}\\b')[-1], '') AS postal,
  regexp_extract_all(plain, {quote(t.NUMBER)}, 1) AS addr_nums, regexp_extract(plain, {quote(t.HOUSE)}, 1) AS house_no, regexp_extract(plain, {quote(t.UNIT)}, 1) AS unit,
  array_to_string(list_transform(list_filter(string_split(plain, ' '), lambda w: w <> ''), lambda w: {case('w', t.STREET_WORDS.items(), 'w')}), ' ') AS wide FROM b1),
b3 AS (SELECT *, {tokens('wide', 'a-z0-9/')} AS addr_tokens FROM b2),
b4 AS (SELECT *, array_to_string(addr_tokens, ' ') AS addr_norm FROM b3),
rec AS MATERIALIZED (SELECT entity_id, source, row_ord, html, business_name, business_address, country, name_norm, name_core, name_clean, name_fold, name_acronym, legal_form, name_alts, name_tokens, name_core_tokens,
  addr_norm, addr_tokens, addr_tail, addr_nums, landmark, postal, house_no, unit, regexp_replace(addr_norm, '[^a-z0-9]', '', 'g') AS addr_clean,
  array_to_string(list_sort(list_filter({tokens("regexp_replace(addr_norm, '(\\d+)(?:st|nd|rd|th)\\b', '\\1', 'g')")}, lambda w: w NOT IN {words_list(t.SORTED_ADDRESS_STOP_WORDS)}))[1:5], '') AS sorted_addr,
  array_to_string(list_transform({tokens('addr_norm')}, lambda w: {fold_token('w')}), ' ') AS addr_fold,
  {case('trim(lower(country))', t.COUNTRY_ALIASES.items(), 'trim(lower(country))')} AS country_norm FROM b4),
s AS (SELECT *, country_norm AS block FROM rec WHERE source = 'S1'),
own_blocks AS (SELECT DISTINCT block FROM s),
p AS (SELECT *, country_norm AS block FROM rec WHERE source <> 'S1' AND country_norm IN (SELECT block FROM own_blocks) UNION ALL
  SELECT rec.*, own_blocks.block FROM rec CROSS JOIN own_blocks WHERE source <> 'S1' AND country_norm NOT IN (SELECT block FROM own_blocks))"""


def ranked(source: str, k: int, order: str = "round(score, 9) DESC") -> str:
    return f"""SELECT s1, r, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY block, s1 ORDER BY {order}, r_ord, r) - 1 AS rank FROM {source}) WHERE rank < {k}"""


EXACT = """own AS (
  SELECT block, entity_id AS s1, 0 AS kind, name_core AS key, country_norm AS part FROM s WHERE name_core <> '' AND country_norm <> '' UNION ALL
  SELECT block, entity_id, 1, name_core, postal FROM s WHERE name_core <> '' AND postal <> '' UNION ALL
  SELECT block, entity_id, 2, name_fold, country_norm FROM s WHERE name_fold <> '' AND country_norm <> '' UNION ALL
  SELECT block, entity_id, 3, name_clean, country_norm FROM s WHERE name_clean <> '' AND country_norm <> ''),
cleaned AS (SELECT block, entity_id AS r, row_ord AS r_ord, country_norm AS part, unnest(list_prepend(name_clean, list_transform(name_alts, lambda a: regexp_replace(lower(a), '[^a-z0-9]', '', 'g')))) AS key,
  generate_subscripts(list_prepend(name_clean, name_alts), 1) AS nth FROM p WHERE country_norm <> ''),
other AS (
  SELECT block, entity_id AS r, row_ord AS r_ord, 0 AS kind, name_core AS key, country_norm AS part FROM p WHERE name_core <> '' AND country_norm <> '' UNION ALL
  SELECT block, entity_id, row_ord, 1, name_core, postal FROM p WHERE name_core <> '' AND postal <> '' UNION ALL
  SELECT block, entity_id, row_ord, 2, name_fold, country_norm FROM p WHERE name_fold <> '' AND country_norm <> '' UNION ALL
  SELECT block, r, r_ord, 3, key, part FROM (SELECT *, row_number() OVER (PARTITION BY block, key, part ORDER BY r_ord, r, nth) AS n FROM cleaned WHERE key <> '') WHERE n <= 50),
exact AS (SELECT block, s1, r, min(kind) AS kind, min(r_ord) AS r_ord, 1.0::DOUBLE AS score FROM own JOIN other USING (block, kind, key, part) GROUP BY block, s1, r)"""

SIZES = "sizes AS (SELECT block, count(*) AS n FROM (SELECT block FROM s UNION ALL SELECT block FROM p) GROUP BY block)"


def idf(name: str, list_expr: str, max_df: int) -> str:
    return f"""{name}_s AS (SELECT block, entity_id AS s1, unnest({list_expr}) AS key FROM s),
{name}_p AS (SELECT block, entity_id AS r, row_ord AS r_ord, unnest({list_expr}) AS key FROM p),
{name}_d AS (SELECT block, key, ln((n + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM {name}_p JOIN sizes USING (block) GROUP BY block, key, n HAVING count(*) <= {max_df}),
{name} AS (SELECT block, s1, r, min(r_ord) AS r_ord, sum(idf) AS score, count(*) AS shared FROM {name}_s JOIN {name}_d USING (block, key) JOIN {name}_p USING (block, key) GROUP BY block, s1, r)"""


RARE = f"{SIZES},\n" + idf("rare", "list_filter(list_distinct(name_core_tokens), lambda w: length(w) >= 2 OR regexp_full_match(w, '[0-9]+'))", 200)

PHONETIC = """heard_p AS (SELECT block, entity_id AS r, row_ord AS r_ord, unnest(list_filter(string_split(name_fold, ' '), lambda w: length(w) >= 4)) AS key FROM p),
few AS (SELECT block, key FROM heard_p GROUP BY block, key HAVING count(*) <= 30),
heard AS (SELECT block, s1, r, min(r_ord) AS r_ord, sum(w) AS score FROM (
  SELECT s.block, s.entity_id AS s1, p.entity_id AS r, p.row_ord AS r_ord, 2.0::DOUBLE AS w FROM s JOIN p ON s.block = p.block AND s.name_acronym = p.name_acronym WHERE length(s.name_acronym) >= 2 UNION ALL
  SELECT block, s1, r, r_ord, 1.0::DOUBLE FROM (SELECT block, entity_id AS s1, unnest(list_filter(string_split(name_fold, ' '), lambda w: length(w) >= 4)) AS key FROM s) JOIN few USING (block, key) JOIN heard_p USING (block, key))
  GROUP BY block, s1, r)"""


def _address_keys(side: str, name: str, columns: str) -> str:
    base = f"FROM {side} WHERE"
    return f"""{name} AS (
  SELECT {columns}, 0 AS kind, postal AS key, house_no AS part {base} postal <> '' AND house_no <> '' UNION ALL
  SELECT {columns}, 1, postal, name_core[1:3] {base} postal <> '' AND length(name_core) >= 3 UNION ALL
  SELECT {columns}, 2, addr_clean[1:25], country_norm {base} length(addr_clean) >= 10 AND country_norm <> '' UNION ALL
  SELECT {columns}, 3, sorted_addr, country_norm {base} length(sorted_addr) >= 6 AND country_norm <> '')"""


ADDRESS_TOKENS = f"list_distinct(list_concat(list_filter(addr_tokens, lambda w: length(w) >= 2 AND w NOT IN {words_list(ADDRESS_STOP_WORDS)}), addr_nums))"
ADDRESS = f"""{SIZES},
{_address_keys('s', 'ka', 'block, entity_id AS s1')},
{_address_keys('p', 'kb0', 'block, entity_id AS r, row_ord AS r_ord')},
kb AS (SELECT block, r, r_ord, kind, key, part FROM (SELECT *, row_number() OVER (PARTITION BY block, kind, key, part ORDER BY r_ord, r) AS n FROM kb0) WHERE kind < 2 OR n <= 15),
{idf('adr', ADDRESS_TOKENS, 250)},
address AS (SELECT block, s1, r, min(r_ord) AS r_ord, max(score) AS score FROM (
  SELECT block, s1, r, r_ord, CASE kind WHEN 0 THEN 10.0 WHEN 1 THEN 8.0 WHEN 2 THEN 7.0 ELSE 6.0 END::DOUBLE AS score FROM ka JOIN kb USING (block, kind, key, part) UNION ALL
  SELECT adr.block, s1, r, r_ord, score FROM adr JOIN s ON s.entity_id = adr.s1 WHERE shared >= 2 OR len(s.addr_nums) > 0) GROUP BY block, s1, r)"""

OVERLAP = """tok_p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, key ORDER BY r_ord, r) AS n FROM (
  SELECT block, entity_id AS r, row_ord AS r_ord, unnest(list_filter(list_distinct(name_core_tokens), lambda w: length(w) >= 2)) AS key FROM p)) WHERE n <= 500),
tok_s AS (SELECT block, entity_id AS s1, unnest(list_filter(list_distinct(name_core_tokens), lambda w: length(w) >= 2)) AS key FROM s),
overlap AS (SELECT x.block, s1, r, r_ord, shared / len(list_distinct(list_concat(s.name_core_tokens, p.name_core_tokens))) AS score FROM (
  SELECT block, s1, r, min(r_ord) AS r_ord, count(*) AS shared FROM tok_s JOIN tok_p USING (block, key) GROUP BY block, s1, r) x JOIN s ON s.entity_id = s1 JOIN p ON p.entity_id = r)"""

SUBSTRING = """sub_s AS (SELECT block, entity_id AS s1, 0 AS kind, name_clean[1:5] AS key, country_norm AS part, name_core AS ca, name_clean AS la FROM s WHERE length(name_core) >= 4 AND length(name_clean) >= 5 UNION ALL
  SELECT block, entity_id, 1, name_core[1:3], country_norm, name_core, name_clean FROM s WHERE length(name_core) >= 4),
sub_p0 AS (SELECT block, entity_id AS r, row_ord AS r_ord, 0 AS kind, name_clean[1:5] AS key, country_norm AS part, name_core AS cb, name_clean AS lb FROM p WHERE length(name_core) >= 4 AND length(name_clean) >= 5 UNION ALL
  SELECT block, entity_id, row_ord, 1, name_core[1:3], country_norm, name_core, name_clean FROM p WHERE length(name_core) >= 4),
sub_p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, kind, key, part ORDER BY r_ord, r) AS n FROM sub_p0) WHERE n <= CASE kind WHEN 0 THEN 50 ELSE 100 END),
sub_h AS (SELECT block, s1, r, r_ord, kind, la, lb,
  CASE WHEN length(ca) <= length(cb) THEN contains(cb, ca) ELSE contains(ca, cb) END AS has, least(length(ca), length(cb)) / greatest(length(ca), length(cb)) AS rc, least(length(la), length(lb)) / greatest(length(la), length(lb)) AS rl
  FROM sub_s JOIN sub_p USING (block, kind, key, part)),
sub AS (SELECT * FROM (SELECT block, s1, r, min(r_ord) AS r_ord, coalesce(max(CASE WHEN has AND rc >= 0.4 THEN rc END), max(CASE WHEN kind = 0 AND (starts_with(la, lb) OR starts_with(lb, la)) AND rl >= 0.5 THEN rl END)) AS score FROM sub_h GROUP BY block, s1, r) WHERE score IS NOT NULL)"""


def _pass(n: int, key: str) -> str:
    return f"""pos{n} AS (SELECT block, entity_id, side, country_norm, row_number() OVER (PARTITION BY block ORDER BY {key}, side, row_ord, entity_id) AS i FROM every_rec),
near{n} AS (SELECT a.block, a.entity_id AS s1, b.entity_id AS r, {n} AS pass, a.i AS i, b.i AS j FROM pos{n} a JOIN pos{n} b ON a.block = b.block AND a.side = 0 AND b.side = 1 AND abs(a.i - b.i) <= 20
  WHERE NOT (a.country_norm <> '' AND b.country_norm <> '' AND a.country_norm <> b.country_norm))"""


NEIGHBOURS = f"""every_rec AS (SELECT block, entity_id, name_core, country_norm, row_ord, 0 AS side FROM s UNION ALL SELECT block, entity_id, name_core, country_norm, row_ord, 1 FROM p),
{_pass(0, 'name_core')},
{_pass(1, 'reverse(name_core)')},
snm AS (SELECT block, s1, r, h.pass AS pass, h.i AS i, h.j AS j FROM (SELECT block, s1, r, min({{'pass': pass, 'j': j, 'i': i}}) AS h FROM (SELECT * FROM near0 UNION ALL SELECT * FROM near1) GROUP BY block, s1, r))"""

TFIDF = r"""sides AS (SELECT DISTINCT block, source FROM p),
txt AS (SELECT s.block, sides.source, 0 AS side, entity_id AS id, 0 AS ord, CASE WHEN name_norm = '' THEN 'empty' ELSE name_norm END AS x FROM s JOIN sides ON s.block = sides.block UNION ALL
  SELECT block, source, 1, entity_id, row_ord, CASE WHEN name_norm = '' THEN 'empty' ELSE name_norm END FROM p),
cnt AS (SELECT block, source, count(*) AS n FROM txt GROUP BY block, source),
wrd AS (SELECT block, source, side, id, ord, ' ' || unnest(list_filter(string_split(x, ' '), lambda w: w <> '')) || ' ' AS w FROM txt),
grm AS (SELECT block, source, side, id, ord, w[i:i + g - 1] AS g FROM (SELECT *, unnest(range(1, greatest(length(w) - g + 1, 1) + 1)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS g FROM wrd) WHERE g = 2 OR length(w) >= g)),
tf AS (SELECT block, source, side, id, ord, g, count(*) AS tf FROM grm GROUP BY ALL),
dfs AS (SELECT block, source, g, count(*) AS df FROM tf GROUP BY ALL),
wei AS (SELECT tf.*, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN dfs USING (block, source, g) JOIN cnt USING (block, source)),
nrm AS (SELECT block, source, side, id, sqrt(sum(w * w)) AS norm FROM wei GROUP BY ALL),
unt AS (SELECT block, source, side, id, ord, g, w / norm AS w FROM wei JOIN nrm USING (block, source, side, id)),
tfidf AS (SELECT a.block, a.source, a.id AS s1, b.id AS r, min(b.ord) AS r_ord, sum(a.w * b.w) AS score FROM unt a JOIN unt b ON a.block = b.block AND a.source = b.source AND a.g = b.g AND a.side = 0 AND b.side = 1 GROUP BY a.block, a.source, a.id, b.id)"""

GOLD = """art AS (SELECT entity_id, source, md5(regexp_extract(html, '(?s)<article>(.*)</article>', 1)) AS h FROM view_raw WHERE contains(html, '</article>')),
gold AS (SELECT a.entity_id AS s1, b.entity_id AS r FROM art a JOIN art b ON a.h = b.h AND a.source = 'S1' AND b.source <> 'S1')"""
PAIRS = OVERLAP + ",\npairs AS (SELECT s1, r, rank, score AS p FROM (SELECT *, row_number() OVER (PARTITION BY block, s1 ORDER BY round(score, 9) DESC, r_ord, r) - 1 AS rank FROM overlap) WHERE rank < 30)"
ENTITIES = "ent AS (SELECT DISTINCT entity_id AS s1, country_norm FROM s)"


def scored(predicted: str) -> str:
    """The CTE `per` (s1, p, g, tp, f05) of predicted pairs."""
    return f"""{ENTITIES},
hits AS (SELECT s1, r, max(p) AS p, max(g) AS g FROM (SELECT DISTINCT s1, r, 1 AS p, 0 AS g FROM {predicted} UNION ALL SELECT DISTINCT s1, r, 0, 1 FROM gold) GROUP BY s1, r),
per0 AS (SELECT ent.s1, country_norm, coalesce(sum(p), 0)::BIGINT AS p, coalesce(sum(g), 0)::BIGINT AS g, coalesce(sum(p * g), 0)::BIGINT AS tp FROM ent LEFT JOIN hits USING (s1) GROUP BY ent.s1, country_norm),
per AS (SELECT *, CASE WHEN g = 0 THEN (p = 0)::INT::DOUBLE ELSE 5.0 * tp / (4.0 * p + g) END AS f05 FROM per0)"""


def phonetic_key(w: str) -> str:
    x = f"CASE WHEN starts_with({w}, 'yu') THEN {w}[2:] ELSE {w} END"
    for a, b in t.PHONETIC_STEPS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"CASE WHEN regexp_full_match({w}, '\\p{{L}}+') THEN {doubles(f'{{k}}[1] || regexp_replace({{k}}[2:], {quote(chr(91) + 'aeiou' + chr(93))}, {quote(str())}, {quote(chr(103))})'.replace('{k}', f'({x})'))} ELSE {w} END"


def columnar() -> str:
    """The CTE `cn` of records normalised by the columnar scheme, of texts in Latin letters."""
    plain = lambda x: f"trim(regexp_replace(replace(strip_accents(replace(lower(nfc_normalize({x})), 'ß', 'ss')), '&', ' and '), '[\\x00-\\x20\\p{{P}}\\p{{S}}\\p{{Z}}]+', ' ', 'g'))"
    for_initials = lambda x: f"replace(regexp_replace(regexp_replace(' ' || replace({x}, ' ', '  ') || ' ', ' (\\p{{L}}) ', ' \x01\\1\x02 ', 'g'), '\x02  \x01', '', 'g'), '  ', ' ')".replace("\x01", chr(1)).replace("\x02", chr(2))
    joined = lambda x: f"trim(replace(replace({for_initials(plain(x))}, '{chr(1)}', ''), '{chr(2)}', ''))"
    places = {name: code for code, name in c.US_STATES.items()} | c.INDIAN_PLACES
    longest = "|".join(sorted(places, key=lambda p: (-len(p), p)))
    split = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    legal = c.LEGAL_WORDS
    return f"""{VIEW},
n1 AS (SELECT entity_id, source, row_ord, {split(joined('business_name'))} AS tk, {split(joined('business_address'))} AS ad, {joined('country')} AS country_norm FROM view_raw),
n2 AS (SELECT *, list_filter(tk, lambda w: w NOT IN {words_list(c.CORE_STOP_WORDS)}) AS pl,
  string_split(regexp_replace(array_to_string(list_transform(ad, lambda w: regexp_replace(w, '^(\\d+)(st|nd|rd|th)$', '\\1')), ' '), '\\b({longest})\\b', '{chr(1)}\\1{chr(1)}', 'g'), '{chr(1)}') AS seg FROM n1),
n3 AS (SELECT *, list_filter(pl, lambda w: w NOT IN {words_list(legal)}) AS co0, {split(f"array_to_string(list_transform(seg, lambda s: {case('s', places.items(), 's')}), '')")} AS at0 FROM n2),
n4 AS (SELECT *, CASE WHEN len(co0) > 0 THEN co0 WHEN len(pl) > 0 THEN pl ELSE tk END AS co, list_transform(at0, lambda w: {case('w', c.SHORT_STREETS.items(), 'w')}) AS at1 FROM n3),
cn AS MATERIALIZED (SELECT entity_id, source, row_ord, country_norm, array_to_string(tk, ' ') AS name_n, array_to_string(co, ' ') AS name_core, array_to_string(list_transform(co, lambda w: {phonetic_key('w')}), ' ') AS name_phon,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(tk, lambda w: w IN {words_list(legal)}), lambda w: {case('w', legal.items(), 'w')}))), ' ') AS legal,
  array_to_string(at1, ' ') AS addr_n, coalesce(list_filter(at1, lambda w: regexp_matches(w, '^[0-9]'))[1], '') AS house,
  array_to_string(list_filter(list_filter(at1, lambda w: regexp_matches(w, '[0-9]')), lambda w, i: list_position(list_filter(at1, lambda v: regexp_matches(v, '[0-9]')), w) = i), ' ') AS nums FROM n4)"""


def rare_keys() -> str:
    """CTEs up to `rk` (s1, r, channel, score, rank) of the rare-key channels on `cn`."""
    split = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    pairs = lambda m, x: f"list_transform(range(1, len({x})), lambda i: '{m}' || {x}[i] || '_' || {x}[i + 1])"
    names = f"list_concat(list_concat(list_transform(list_filter(nt, lambda w: length(w) >= 2 OR regexp_full_match(w, '[0-9]')), lambda w: 'n' || w), {pairs('b', 'nt')}), list_concat(list_transform(list_filter(pt, lambda w: length(w) >= 3), lambda w: 'p' || w), CASE WHEN name_core <> '' THEN ['w' || name_core] ELSE [] END))"
    places = f"list_concat(list_transform(list_filter(dt, lambda w: length(w) >= 3 OR regexp_matches(w, '[0-9]')), lambda w: 'a' || w), {pairs('c', 'dt')})"
    limits = {"name": 15, "addr": 25, "joint": 40}
    ranked = " UNION ALL ".join(f"SELECT '{ch}' AS channel, entity_id AS id, source, row_ord, country_norm AS block, {k} AS ks FROM kt" for ch, k in (("name", "kn"), ("addr", "ka"), ("joint", "list_concat(kn, ka)")))
    most = "CASE channel " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in limits.items()) + " END"
    return f"""kt0 AS (SELECT *, {split('name_core')} AS nt, {split('name_phon')} AS pt, {split('addr_n')} AS dt FROM cn),
kt AS (SELECT *, {names} AS kn, {places} AS ka FROM kt0),
kx AS (SELECT channel, id, source, row_ord, block, key, min(nth) AS nth FROM (SELECT channel, id, source, row_ord, block, unnest(ks) AS key, generate_subscripts(ks, 1) AS nth FROM ({ranked})) GROUP BY channel, id, source, row_ord, block, key),
np AS (SELECT country_norm AS block, count(*) AS n FROM cn WHERE source <> 'S1' GROUP BY country_norm),
kd AS (SELECT channel, block, key, count(*) AS df FROM kx WHERE source <> 'S1' GROUP BY channel, block, key HAVING count(*) <= 1000),
kq AS (SELECT * FROM (SELECT kx.channel, kx.block, id AS s1, key, ln((np.n + 1) / df) AS w, row_number() OVER (PARTITION BY kx.channel, kx.block, id ORDER BY df, nth) AS nr FROM kx JOIN kd USING (channel, block, key) JOIN np ON np.block = kx.block WHERE source = 'S1') WHERE nr <= {most}),
ks AS (SELECT kq.channel, kq.block, s1, p.id AS r, min(p.row_ord) AS r_ord, sum(w) AS score FROM kq JOIN kx p ON p.channel = kq.channel AND p.block = kq.block AND p.key = kq.key AND p.source <> 'S1' GROUP BY kq.channel, kq.block, s1, p.id),
rk AS (SELECT * FROM (SELECT channel, s1, r, score, row_number() OVER (PARTITION BY channel, block, s1 ORDER BY round(score, 9) DESC, r_ord, r) - 1 AS rank FROM ks) WHERE rank < 20)"""


def query(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
