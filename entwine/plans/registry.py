"""The registered queries and the SQL that each must agree with.

The registry view takes the pages as business records: the title is the name, the
url the address and the page's language the country; page ids deal all pages
to the three sources. Links with the same article stand for gold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import text as t, unicode as u
from ..functions.similarity import levenshtein, measures
from ..operators import candidates as cand, channels as ch, checks, decide, features as feat, learn, metrics
from ..operators.canonical import canonicalize, normalise
from ..operators.running import scratch, stored
from ..sources import synthetic, tables
from . import oracle as o
from .config import Config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# The registry view.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("S"), (F.col("page_id") % 3 + 1).cast("string"))
    address = F.concat(F.regexp_extract("url", "/([0-9]+)", 1), F.lit(" "), F.replace(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(", ")))
    return table(spark, sf_dir, "pages").select(
        F.concat(source, F.lit("-"), F.col("page_id").cast("string")).alias("entity_id"), source.alias("source"), F.col("page_id").alias("row_ord"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("business_name"), address.alias("business_address"),
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("country"),
        F.when(F.contains("html", F.lit("</article>")), F.md5(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1))).alias("article"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(S1, pool) canonical records in blocks by country; pool records of countries that S1 lacks are in every block."""
    rec = canonicalize(raw_records(spark, sf_dir))
    return cand.assign_blocks(rec.where("source = 'S1'"), rec.where("source <> 'S1'"))


def gold_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_records(spark, sf_dir).where("article is not null").select("entity_id", "source", "article")
    a = raw.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "article")
    return a.join(raw.where("source <> 'S1'").select(F.col("entity_id").alias("r"), "article"), "article").select("s1", "r")


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs (s1, r, rank, p) whose probability is the token overlap."""
    return ch.token_overlap(*sides(spark, sf_dir)).select("s1", "r", F.col("rank").cast("long").alias("rank"), F.col("score").alias("p"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir)[0].select(F.col("entity_id").alias("s1"), "country_norm").distinct()


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Scans and normalisation.


@query(o.query(o.VIEW, body="SELECT source, country, count(*) AS n, sum(length(business_name))::BIGINT AS chars FROM view_raw GROUP BY source, country"))
def scan_count(spark, sf_dir):
    return raw_records(spark, sf_dir).groupBy("source", "country").agg(F.count("*").alias("n"), F.sum(F.length("business_name")).cast("long").alias("chars"))


@query(o.query(o.RECORDS, body="SELECT entity_id, name_norm, name_core, name_clean, name_fold, name_acronym, legal_form, array_to_string(name_alts, '|') AS alts FROM rec"))
def canonical_names(spark, sf_dir):
    rec = canonicalize(raw_records(spark, sf_dir))
    return rec.select("entity_id", "name_norm", "name_core", "name_clean", "name_fold", "name_acronym", "legal_form", F.array_join("name_alts", "|").alias("alts"))


@query(o.query(o.RECORDS, body="SELECT entity_id, addr_norm, addr_tail, landmark, postal, house_no, unit, array_to_string(addr_nums, ' ') AS nums, addr_clean, sorted_addr, addr_fold, country_norm FROM rec"))
def canonical_addresses(spark, sf_dir):
    rec = canonicalize(raw_records(spark, sf_dir))
    return rec.select("entity_id", "addr_norm", "addr_tail", "landmark", "postal", "house_no", "unit", F.array_join("addr_nums", " ").alias("nums"), "addr_clean", "sorted_addr", "addr_fold", "country_norm")


@query("SELECT doc_id, array_to_string(list_transform(" + o.tokens("lower(strip_accents(lower(text)))") + ", lambda w: " + o.fold_token("w") + "), ' ') AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.fold(F.lower("text")).alias("folded"))


@query(f"SELECT doc_id, legal_form FROM (SELECT doc_id, {o.word_letters('lower(text)')} AS p5 FROM documents) x, LATERAL (SELECT {o.legal_case()} AS legal_form)")
def legal_form_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("p")).select("doc_id", t.legal_form(F.col("p")).alias("legal_form"))


@query(rf"""SELECT doc_id, coalesce(nullif(regexp_extract(x, '\b(\d{{5}})-\d{{4}}\b', 1), ''), regexp_extract_all(x, '\b\d{{5,6}}\b')[-1], regexp_extract_all(x, '\b\d{{4}}\b')[-1], '') AS postal
FROM (SELECT doc_id, {o.word_letters('text')} AS x FROM documents)""")
def postal_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.postal_code(F.col("text")).alias("postal"))


@query("SELECT doc_id, trim(lower(nfc_normalize(text))) AS lower, strip_accents(text) AS plain FROM documents")
def unicode_steps(spark, sf_dir):
    """NFKC in lower case, and accents stripped, of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", u.nfkc_lower("text").alias("lower"), u.strip_accents("text").alias("plain"))


@query()
def transliterations(spark, sf_dir):
    """Both schemes' Latin spellings of whole texts."""
    found = table(spark, sf_dir, "documents").select("doc_id", u.transliterate_indic("text").alias("by_place"), u.base_tokens("text").alias("by_name"))
    return found.select("doc_id", "by_place", F.col("by_name.text").alias("by_name"), F.col("by_name.indic").alias("indic"))


@query(o.query(o.RECORDS, body="""SELECT a.entity_id AS s1, b.entity_id AS r, ((a.house_no <> '') AND (a.house_no = b.house_no))::BIGINT AS house_eq, ((a.house_no <> '') AND (b.house_no <> '') AND (a.house_no <> b.house_no))::BIGINT AS house_conflict
FROM s a JOIN p b ON a.name_core = b.name_core AND a.name_core <> ''"""))
def house_number_compare(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    a = s1.select(F.col("entity_id").alias("s1"), "name_core", F.col("house_no").alias("ha")).where("name_core <> ''")
    b = pool.select(F.col("entity_id").alias("r"), "name_core", F.col("house_no").alias("hb"))
    eq, conflict = t.agreement(F.col("ha"), F.col("hb"))
    return a.join(b, "name_core").select("s1", "r", eq.cast("long").alias("house_eq"), conflict.cast("long").alias("house_conflict"))


# Blocking channels.


def channel_query(name: str, fn, sql: str) -> None:
    def run(spark, sf_dir):
        return rounded(longs(fn(*sides(spark, sf_dir)).select("s1", "r", "rank", "score"), "rank"), "score")

    run.__name__ = name
    query(sql)(run)


channel_query("exact_key_candidates", ch.exact, o.query(o.RECORDS, o.EXACT, body=o.ranked("exact", 50, "kind")))
channel_query("rare_token_topk", ch.rare_tokens, o.query(o.RECORDS, o.RARE, body=o.ranked("rare", 50)))
channel_query("acronym_phonetic_topk", ch.phonetic, o.query(o.RECORDS, o.PHONETIC, body=o.ranked("heard", 15)))
channel_query("address_topk", ch.address, o.query(o.RECORDS, o.ADDRESS, body=o.ranked("address", 30)))
channel_query("token_overlap_jaccard", ch.token_overlap, o.query(o.RECORDS, o.OVERLAP, body=o.ranked("overlap", 30)))
channel_query("substring_containment", ch.substring, o.query(o.RECORDS, o.SUBSTRING, body=o.ranked("sub", 20)))
channel_query("sorted_neighbourhood", ch.sorted_neighbourhood, o.query(o.RECORDS, o.NEIGHBOURS, body="SELECT s1, r, row_number() OVER (PARTITION BY block, s1, pass ORDER BY j) - 1 AS rank, round(1.0::DOUBLE / (abs(i - j) + 1), 6) AS score FROM snm"))
channel_query("tfidf_topk", ch.tfidf, o.query(o.RECORDS, o.TFIDF, body="SELECT s1, r, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY block, source, s1 ORDER BY round(score, 9) DESC, r_ord, r) - 1 AS rank FROM tfidf) WHERE rank < 50 AND score > 0.05"))

FOUR = ("c1_exact", "c3_rare", "c4_phonetic", "c8_token_overlap")
HITS = ",\n".join((o.RECORDS, o.EXACT, o.RARE, o.PHONETIC, o.OVERLAP)) + ",\n" + """found AS (
  SELECT 'c1_exact' AS channel, 1 AS bit, * FROM ({}) UNION ALL SELECT 'c3_rare', 4, * FROM ({}) UNION ALL SELECT 'c4_phonetic', 8, * FROM ({}) UNION ALL SELECT 'c8_token_overlap', 256, * FROM ({})),
un AS (SELECT s1, r, bit_or(bit)::BIGINT AS mask, count(*) AS n_channels, min(rank) AS min_rank, max(score) AS max_score FROM found GROUP BY s1, r)""".format(
    o.ranked("exact", 50, "kind"), o.ranked("rare", 50), o.ranked("heard", 15), o.ranked("overlap", 30))


def four_channels(spark, sf_dir) -> DataFrame:
    hits = ch_hits(spark, sf_dir)
    return cand.union(hits)


def ch_hits(spark, sf_dir) -> DataFrame:
    return cand.run_channels(*sides(spark, sf_dir), list(FOUR)).withColumn("score", F.round("score", 6))


@query("WITH " + HITS + "\nSELECT s1, r, mask, n_channels, min_rank, max_score FROM un")
def channel_union_provenance(spark, sf_dir):
    return longs(four_channels(spark, sf_dir), "mask", "n_channels", "min_rank").select("s1", "r", "mask", "n_channels", "min_rank", "max_score")


@query("WITH " + HITS + """,
pr AS (SELECT *, 100.0 * n_channels - min_rank + 10.0 * max_score AS priority, (n_channels >= 2)::INT AS multi FROM un),
rk AS (SELECT *, sum(multi) OVER (PARTITION BY s1) AS kept, row_number() OVER (PARTITION BY s1, multi ORDER BY round(priority, 6) DESC, r) AS n FROM pr)
SELECT s1, r, round(priority, 6) AS priority FROM rk WHERE multi = 1 OR n <= greatest(20 - kept, 0)""")
def budget_prune(spark, sf_dir):
    return rounded(cand.prune(four_channels(spark, sf_dir), budget=20).select("s1", "r", "priority"), "priority")


def whole_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(S1, pool) canonical records, without blocks; records of countries that S1 lacks included."""
    rec = stored(canonicalize(raw_records(spark, sf_dir)))
    return rec.where("source = 'S1'"), rec.where("source <> 'S1'")


def all_channels(s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pruned, union) candidates with the settings of a run: every channel, the expansion, the whole budget."""
    c = Config()
    return cand.block_and_prune(s1, pool, c.budget, c.by_country, c.expansion, list(c.channels), **c.channel_options())


@query()
def all_channels_union(spark, sf_dir):
    _, union = all_channels(*whole_sides(spark, sf_dir))
    return rounded(longs(union, "mask", "n_channels", "min_rank").select("s1", "r", "mask", "n_channels", "min_rank", "max_score"), "max_score")


@query()
def all_channels_prune(spark, sf_dir):
    pruned, _ = all_channels(*whole_sides(spark, sf_dir))
    return rounded(pruned.select("s1", "r", "priority"), "priority")


@query()
def sibling_expansion(spark, sf_dir):
    c = Config()
    s1, pool = whole_sides(spark, sf_dir)
    pairs = cand.candidates(s1, pool, c.by_country, list(c.channels), **c.channel_options())
    return rounded(cand.siblings(pairs, pool), "score")


@query(o.query(o.RECORDS, "own AS (SELECT DISTINCT country_norm AS block FROM rec WHERE source = 'S1')", body="""SELECT entity_id, country_norm AS block FROM rec WHERE source = 'S1' OR country_norm IN (SELECT block FROM own)
UNION ALL SELECT entity_id, block FROM rec CROSS JOIN own WHERE source <> 'S1' AND country_norm NOT IN (SELECT block FROM own)"""))
def country_blocks(spark, sf_dir):
    rec = canonicalize(raw_records(spark, sf_dir))
    a, b = cand.assign_blocks(rec.where("source = 'S1'"), rec.where("source <> 'S1'"))
    return a.select("entity_id", "block").unionByName(b.select("entity_id", "block"))


# Statistics and pair features.


@query(o.query(o.RECORDS, body="""SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM rec) + 1.0) / (count(*) + 1.0)) + 1.0, 6) AS idf
FROM (SELECT unnest(list_distinct(list_concat(name_core_tokens, addr_tokens))) AS token FROM rec) GROUP BY token"""))
def doc_freq_idf(spark, sf_dir):
    rec = canonicalize(raw_records(spark, sf_dir))
    df, n = feat.document_frequency(rec)
    return df.select("token", "df", F.round(feat.idf(F.col("df"), n), 6).alias("idf"))


@query(o.query(o.RECORDS, o.PAIRS, """dfq AS (SELECT token, ln(((SELECT count(*) FROM rec) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM (SELECT unnest(list_distinct(list_concat(name_core_tokens, addr_tokens))) AS token FROM rec) GROUP BY token),
sides AS (SELECT s1, r, unnest(list_distinct(list_concat(s.name_core_tokens, p.name_core_tokens))) AS token, s.name_core_tokens AS ta, p.name_core_tokens AS tb FROM pairs JOIN s ON s.entity_id = s1 JOIN p ON p.entity_id = r)""",
    body="""SELECT s1, r, round(coalesce(sum(idf) FILTER (list_contains(ta, token) AND list_contains(tb, token)), 0), 6) AS shared_sum, round(coalesce(max(idf) FILTER (list_contains(ta, token) AND list_contains(tb, token)), 0), 6) AS shared_max,
round(coalesce(sum(idf) FILTER (NOT list_contains(tb, token)), 0), 6) AS unshared_sum_a, round(coalesce(sum(idf) FILTER (NOT list_contains(ta, token)), 0), 6) AS unshared_sum_b,
round(coalesce(max(idf) FILTER (NOT (list_contains(ta, token) AND list_contains(tb, token))), 0), 6) AS unshared_max FROM sides JOIN dfq USING (token) GROUP BY s1, r"""))
def idf_shared_unshared(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    df, n = feat.document_frequency(canonicalize(raw_records(spark, sf_dir)))
    pairs = feat.attach(overlap_pairs(spark, sf_dir).select("s1", "r"), *(feat.with_idf(x.select("entity_id", "name_core_tokens", "addr_tokens"), df, n) for x in (s1, pool)))
    found = feat.shared_unshared(F.col("a_name_core_tokens"), F.col("b_name_core_tokens"), F.col("a_idf"), F.col("b_idf"))
    return pairs.select("s1", "r", *(F.round(x, 6).alias(k) for k, x in found.items()))


def named_pairs(spark, sf_dir) -> DataFrame:
    s1, pool = sides(spark, sf_dir)
    columns = ("entity_id", "name_core", "name_core_tokens", "addr_norm")
    return feat.attach(overlap_pairs(spark, sf_dir).select("s1", "r"), s1.select(*columns), pool.select(*columns))


SIM = o.query(o.RECORDS, o.PAIRS, "x AS (SELECT s1, r, s.name_core AS a, p.name_core AS b, s.name_core_tokens AS ta, p.name_core_tokens AS tb FROM pairs JOIN s ON s.entity_id = s1 JOIN p ON p.entity_id = r)", body="SELECT s1, r, {} FROM x")


@query(SIM.replace("{}", "round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS sim"))
def levenshtein_sim(spark, sf_dir):
    return named_pairs(spark, sf_dir).select("s1", "r", F.round(levenshtein(F.col("a_name_core"), F.col("b_name_core")), 6).alias("sim"))


@query(SIM.replace("{}", "round(jaro_winkler_similarity(a, b), 6) AS jw, round(jaro_similarity(a, b), 6) AS jaro, round(1.0 - damerau_levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS damerau"))
def jaro_winkler_damerau_sim(spark, sf_dir):
    m = measures({"jw": ("jaro_winkler", "a_name_core", "b_name_core"), "jaro": ("jaro", "a_name_core", "b_name_core"), "damerau": ("damerau_similarity", "a_name_core", "b_name_core")})
    return rounded(named_pairs(spark, sf_dir).select("s1", "r", m.alias("m")).select("s1", "r", "m.*"), "jw", "jaro", "damerau")


@query(SIM.replace("{}", "round(len(list_intersect(list_distinct(ta), list_distinct(tb)))::DOUBLE / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard, (len(list_distinct(list_concat(ta, tb))) - len(list_intersect(list_distinct(ta), list_distinct(tb))))::BIGINT AS unshared"))
def token_jaccard(spark, sf_dir):
    a, b = F.col("a_name_core_tokens"), F.col("b_name_core_tokens")
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return named_pairs(spark, sf_dir).select("s1", "r", F.round(both / every, 6).alias("jaccard"), (every - both).cast("long").alias("unshared"))


def full_features(spark, sf_dir) -> DataFrame:
    s1, pool = whole_sides(spark, sf_dir)
    return features_of(spark, sf_dir, s1, pool, all_channels(s1, pool)[0])


def features_of(spark, sf_dir, s1: DataFrame, pool: DataFrame, pruned: DataFrame) -> DataFrame:
    df, n = feat.document_frequency(canonicalize(raw_records(spark, sf_dir)))
    pruned = pruned.withColumn("cand_count", F.count("*").over(Window.partitionBy("s1"))).select("s1", "r", "mask", "rank", "cand_count")
    return feat.pair_features(feat.attach(pruned, feat.with_idf(s1, df, n), feat.with_idf(pool, df, n)))


@query()
def pair_features_full(spark, sf_dir):
    return full_features(spark, sf_dir)


@query()
def pair_features_light(spark, sf_dir):
    return feat.light_features(full_features(spark, sf_dir))


def _eq(c: str) -> str:
    return f"(a.{c} <> '' AND a.{c} = b.{c})::INT::DOUBLE"


def _differ(c: str) -> str:
    return f"(a.{c} <> '' AND b.{c} <> '' AND a.{c} <> b.{c})::INT::DOUBLE"


def _share(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({x}), list_distinct({y})))::DOUBLE / len(list_distinct({x})) END"


def _jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({x}), list_distinct({y})))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"


def _lengths(x: str, y: str) -> str:
    return f"CASE WHEN greatest({x}, {y}) = 0 THEN 1 ELSE least({x}, {y})::DOUBLE / greatest({x}, {y}) END"


_DIGITS = {s: f"list_sort(list_distinct(regexp_extract_all({s}.business_name, '[0-9]')))" for s in "ab"}
_TAIL = {s: f"list_filter(string_split({s}.addr_tail, ' '), lambda w: w <> '')" for s in "ab"}
PLAIN_FEATURES = {
    "name_exact_norm": _eq("name_norm"), "name_exact_core": _eq("name_core"), "name_exact_fold": _eq("name_fold"),
    "name_lev_ratio_core": "CASE WHEN greatest(length(a.name_core), length(b.name_core)) = 0 THEN 1 ELSE 1 - levenshtein(a.name_core, b.name_core)::DOUBLE / greatest(length(a.name_core), length(b.name_core)) END",
    "addr_lev_ratio": "CASE WHEN greatest(length(a.addr_norm), length(b.addr_norm)) = 0 THEN 1 ELSE 1 - levenshtein(a.addr_norm, b.addr_norm)::DOUBLE / greatest(length(a.addr_norm), length(b.addr_norm)) END",
    "name_token_jaccard_core": _jaccard("a.name_core_tokens", "b.name_core_tokens"),
    "name_first_token_eq": "coalesce(a.name_core_tokens[1] = b.name_core_tokens[1], false)::INT::DOUBLE", "name_last_token_eq": "coalesce(a.name_core_tokens[-1] = b.name_core_tokens[-1], false)::INT::DOUBLE",
    "name_acronym_match": "((a.name_acronym <> '' AND len(b.name_core_tokens) > 0 AND (list_contains(b.name_core_tokens, a.name_acronym) OR a.name_acronym = b.name_acronym)) OR (b.name_acronym <> '' AND len(a.name_core_tokens) > 0 AND (list_contains(a.name_core_tokens, b.name_acronym) OR a.name_acronym = b.name_acronym)))::INT::DOUBLE",
    "legal_form_eq": _eq("legal_form"), "legal_form_conflict": _differ("legal_form"),
    "name_len_ratio_chars": _lengths("length(a.name_core)", "length(b.name_core)"), "name_len_ratio_tokens": _lengths("len(a.name_core_tokens)", "len(b.name_core_tokens)"),
    "name_n_tokens_a": "len(a.name_core_tokens)::DOUBLE", "name_n_tokens_b": "len(b.name_core_tokens)::DOUBLE",
    "digits_in_name_eq": f"(len({_DIGITS['a']}) > 0 AND len({_DIGITS['b']}) > 0 AND {_DIGITS['a']} = {_DIGITS['b']})::INT::DOUBLE", "digits_in_name_conflict": f"(len({_DIGITS['a']}) > 0 AND len({_DIGITS['b']}) > 0 AND {_DIGITS['a']} <> {_DIGITS['b']})::INT::DOUBLE",
    "addr_exact_eq": _eq("addr_norm"), "postal_eq": _eq("postal"), "postal_conflict": _differ("postal"), "postal_both_present": "(a.postal <> '' AND b.postal <> '')::INT::DOUBLE",
    "house_eq": _eq("house_no"), "house_conflict": _differ("house_no"), "unit_eq": _eq("unit"), "unit_conflict": _differ("unit"),
    "nums_jaccard": f"CASE WHEN len(a.addr_nums) > 0 AND len(b.addr_nums) > 0 THEN {_jaccard('a.addr_nums', 'b.addr_nums')} ELSE 0 END",
    "nums_conflict_count": "CASE WHEN len(a.addr_nums) > 0 AND len(b.addr_nums) > 0 THEN len(list_distinct(list_concat(a.addr_nums, b.addr_nums))) - len(list_intersect(list_distinct(a.addr_nums), list_distinct(b.addr_nums))) ELSE 0 END::DOUBLE",
    "tail_token_overlap": f"CASE WHEN len({_TAIL['a']}) > 0 AND len({_TAIL['b']}) > 0 THEN {_jaccard(_TAIL['a'], _TAIL['b'])} ELSE 0 END",
    "landmark_present_a": "(a.landmark <> '')::INT::DOUBLE", "landmark_present_b": "(b.landmark <> '')::INT::DOUBLE",
    "addr_len_ratio": _lengths("length(a.addr_norm)", "length(b.addr_norm)"), "same_country": _eq("country_norm"), "is_s3": "(b.source = 'S3')::INT::DOUBLE",
    "name_in_addr_a2b": _share("a.name_core_tokens", "b.addr_tokens"), "name_in_addr_b2a": _share("b.name_core_tokens", "a.addr_tokens"),
    "channel_mask": "q.mask::DOUBLE", "n_channels": "q.n_channels::DOUBLE", "cand_count_i": "q.cand_count::DOUBLE", "name_jw_core": "CASE WHEN a.name_core = b.name_core THEN 1 ELSE jaro_winkler_similarity(a.name_core, b.name_core) END",
}


@query("WITH " + HITS + """,
pr AS (SELECT *, 100.0 * n_channels - min_rank + 10.0 * max_score AS priority, (n_channels >= 2)::INT AS multi FROM un),
kp AS (SELECT *, sum(multi) OVER (PARTITION BY s1) AS kept, row_number() OVER (PARTITION BY s1, multi ORDER BY round(priority, 6) DESC, r) AS n FROM pr),
q AS (SELECT *, count(*) OVER (PARTITION BY s1) AS cand_count FROM kp WHERE multi = 1 OR n <= greatest(20 - kept, 0))
SELECT q.s1, q.r, """ + ", ".join(f"round({x}, 6) AS {k}" for k, x in PLAIN_FEATURES.items()) + " FROM q JOIN rec a ON a.entity_id = q.s1 JOIN rec b ON b.entity_id = q.r")
def pair_features_plain(spark, sf_dir):
    """Those of the full scheme's features that SQL can say, of the channels and the budget that its SQL has."""
    pruned = cand.prune(four_channels(spark, sf_dir), budget=20)
    return rounded(features_of(spark, sf_dir, *sides(spark, sf_dir), pruned).select("s1", "r", *PLAIN_FEATURES), *PLAIN_FEATURES)


# The columnar scheme.


def columnar_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rec = normalise(raw_records(spark, sf_dir)).withColumn("block", F.col("country_norm"))
    return rec.where("source = 'S1'"), rec.where("source <> 'S1'")


COLUMNAR = o.columnar()


@query(o.query(COLUMNAR, body="SELECT entity_id, name_n, name_core, name_phon, legal, addr_n, house, nums, country_norm FROM cn"))
def columnar_normalise(spark, sf_dir):
    return normalise(raw_records(spark, sf_dir)).select("entity_id", "name_n", "name_core", "name_phon", "legal", "addr_n", "house", "nums", "country_norm")


@query(o.query(COLUMNAR, o.rare_keys(), body="""SELECT s1, r, max(CASE WHEN channel = 'name' THEN round(score, 6) END) AS name_score, max(CASE WHEN channel = 'name' THEN rank END) AS name_rank, max(CASE WHEN channel = 'addr' THEN round(score, 6) END) AS addr_score,
max(CASE WHEN channel = 'addr' THEN rank END) AS addr_rank, max(CASE WHEN channel = 'joint' THEN round(score, 6) END) AS joint_score, max(CASE WHEN channel = 'joint' THEN rank END) AS joint_rank, count(*) AS n_channels, count(*) OVER (PARTITION BY s1) AS cand_count FROM rk GROUP BY s1, r"""))
def rare_key_candidates(spark, sf_dir):
    found = rounded(cand.rare_key_candidates(*columnar_sides(spark, sf_dir)), "name_score", "addr_score", "joint_score").drop("block")
    return longs(found, "name_rank", "addr_rank", "joint_rank", "n_channels", "cand_count")


@query()
def pair_features_columnar(spark, sf_dir):
    s1, pool = columnar_sides(spark, sf_dir)
    return feat.columnar_features(feat.attach(cand.rare_key_candidates(s1, pool).drop("block"), s1, pool))


@query()
def baseline_exact_greedy(spark, sf_dir):
    return rounded(cand.exact_greedy(*sides(spark, sf_dir)), "score")


def _light(side: str, columns: str) -> str:
    kinds = {
        "core": "name_core", "fold": "CASE WHEN name_fold <> name_core THEN name_fold ELSE '' END", "clean": "name_clean", "house": "CASE WHEN postal <> '' AND house_no <> '' THEN postal || '|' || house_no ELSE '' END",
        "addr": "CASE WHEN length(addr_clean) >= 10 THEN addr_clean[1:25] ELSE '' END", "sorted": "CASE WHEN length(sorted_addr) >= 6 THEN sorted_addr ELSE '' END",
    }
    each = " UNION ALL ".join(f"SELECT {columns}, '{k}' AS kind, {x} AS key FROM {side}" for k, x in kinds.items())
    return f"SELECT * FROM ({each} UNION ALL SELECT {columns}, 'token', unnest(list_filter(list_distinct(name_core_tokens), lambda w: length(w) >= 3)) FROM {side}) WHERE key <> ''"


@query(o.query(o.RECORDS, f"ls AS ({_light('s', 'block, entity_id AS s1')})", f"lp0 AS ({_light('p', 'block, entity_id AS r, row_ord AS r_ord')})",
    "lp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, kind, key ORDER BY r_ord, r) AS n FROM lp0) WHERE n <= CASE WHEN kind IN ('core', 'fold', 'clean') THEN 50 WHEN kind = 'token' THEN 400 ELSE 20 END)",
    "lh AS (SELECT block, s1, r, min(r_ord) AS r_ord, count(DISTINCT kind) AS score FROM ls JOIN lp USING (block, kind, key) GROUP BY block, s1, r)",
    body="SELECT s1, r, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY block, s1 ORDER BY score DESC, r_ord, r) - 1 AS rank FROM lh) WHERE rank < 100"))
def light_index_candidates(spark, sf_dir):
    return longs(cand.count_of_keys(*sides(spark, sf_dir)), "rank", "score").drop("block")


_FOLD = "CASE WHEN name_fold <> name_core THEN name_fold ELSE '' END"


def _indexes(side: str, columns: str, folds: str) -> str:
    kinds = {
        0: "name_core", 1: folds, 2: "name_clean", 4: "CASE WHEN length(addr_clean) >= 10 THEN addr_clean[1:25] ELSE '' END",
        5: "CASE WHEN postal <> '' AND house_no <> '' THEN postal || '|' || house_no ELSE '' END", 6: "CASE WHEN length(sorted_addr) >= 6 THEN sorted_addr ELSE '' END",
    }
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {columns}, {k} AS kind, {x} AS key FROM {side}" for k, x in kinds.items()) + ") WHERE key <> ''"


@query(o.query(o.RECORDS, f"ia AS ({_indexes('s', 'block, entity_id AS s1', 'name_fold')})", f"ib0 AS ({_indexes('p', 'block, entity_id AS r, row_ord AS r_ord', _FOLD)})",
    "ib AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, kind, key ORDER BY r_ord, r) AS n FROM ib0) WHERE n <= CASE WHEN kind <= 2 THEN 50 WHEN kind = 5 THEN 15 ELSE 20 END)",
    "ih AS (SELECT s1, r, kind, 0 AS less, r_ord FROM ia JOIN ib USING (block, kind, key))",
    "tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, key ORDER BY r_ord, r) AS n FROM (SELECT block, entity_id AS r, row_ord AS r_ord, unnest(list_filter(list_distinct(name_core_tokens), lambda w: length(w) >= 2)) AS key FROM p)) WHERE n <= 500)",
    "ts AS (SELECT block, entity_id AS s1, unnest(list_filter(list_distinct(name_core_tokens), lambda w: length(w) >= 2)) AS key FROM s WHERE len(name_core_tokens) >= 2)",
    "sh AS (SELECT s1, r, min(r_ord) AS r_ord, count(*) AS n FROM ts JOIN tp USING (block, key) GROUP BY s1, r HAVING count(*) >= 2)",
    "sn AS (SELECT s1, r, 3 AS kind, -n AS less, r_ord FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY n DESC, r_ord, r) AS m FROM sh WHERE NOT EXISTS (SELECT 1 FROM ih WHERE ih.s1 = sh.s1 AND ih.r = sh.r AND kind <= 2)) WHERE m <= 30)",
    "fs AS (SELECT s1, r, min({'kind': kind, 'less': less, 'r_ord': r_ord}) AS place FROM (SELECT * FROM ih UNION ALL SELECT * FROM sn) GROUP BY s1, r)",
    "pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY place, r) AS n FROM fs) WHERE n <= 60)",
    body="SELECT s1, r, n - 1 AS ord FROM (SELECT pl.s1, pl.r, pl.n, row_number() OVER (PARTITION BY pl.r ORDER BY s.row_ord, pl.s1) AS m FROM pl JOIN s ON s.entity_id = pl.s1) WHERE m = 1"))
def inverted_index_baseline(spark, sf_dir):
    """The second baseline: candidates of the inverted indexes, each pool record for the first entity in file order that has it."""
    s1, pool = sides(spark, sf_dir)
    found = cand.inverted_index(s1, pool).join(s1.select(F.col("entity_id").alias("s1"), "row_ord"), "s1")
    return longs(decide.first_come(found).select("s1", "r", "ord"), "ord")


# Group context and decisions.

CONTEXT = """c1 AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, r) - 1 AS rk, max(p) OVER (PARTITION BY s1) AS best, sum((p >= 0.5)::INT) OVER (PARTITION BY s1) AS above, sum(p) OVER (PARTITION BY s1) AS total,
  row_number() OVER (PARTITION BY r ORDER BY p DESC, s1) - 1 AS rev, max(p) OVER (PARTITION BY r) AS top FROM (SELECT s1, r, round(p, 9) AS p FROM pairs)),
c2 AS (SELECT *, coalesce(max(CASE WHEN rk = 1 THEN p END) OVER (PARTITION BY s1), 0) AS second, -sum(p / total * ln(p / total + 1e-12)) OVER (PARTITION BY s1) AS entropy, coalesce(max(CASE WHEN rev = 1 THEN p END) OVER (PARTITION BY r), 0) AS back FROM c1)"""


def scored_pairs(spark, sf_dir) -> DataFrame:
    return overlap_pairs(spark, sf_dir).select("s1", "r", F.round("p", 9).alias("p"))


@query(o.query(o.RECORDS, o.PAIRS, CONTEXT, body="""SELECT s1, r, rk AS p_rank_in_s1, round(best - p, 6) AS p_gap_to_best, round(second, 6) AS p_second_in_s1, above::BIGINT AS n_above_half_in_s1, round(total, 6) AS p_sum_in_s1,
round(entropy, 5) + 0.0 AS p_entropy_in_s1, rev AS rev_rank, round(CASE WHEN rev = 0 THEN p - back ELSE p - top END, 6) AS rev_gap FROM c2"""))
def group_context(spark, sf_dir):
    g = feat.group_context(scored_pairs(spark, sf_dir))
    g = rounded(longs(g, "p_rank_in_s1", "n_above_half_in_s1", "rev_rank"), "p_gap_to_best", "p_second_in_s1", "p_sum_in_s1", "rev_gap").withColumn("p_entropy_in_s1", F.round("p_entropy_in_s1", 5))
    return g.select("s1", "r", "p_rank_in_s1", "p_gap_to_best", "p_second_in_s1", "n_above_half_in_s1", "p_sum_in_s1", "p_entropy_in_s1", "rev_rank", "rev_gap")


@query(o.query(o.RECORDS, o.PAIRS, """gc AS (SELECT s1, r, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, r) AS rank2a, max(p) OVER (PARTITION BY s1) AS p_best, sum((p > 0.5)::INT) OVER (PARTITION BY s1) AS n_above50, sum(p) OVER (PARTITION BY s1) AS sum_p FROM (SELECT s1, r, round(p, 9) AS p FROM pairs))""",
    body="""SELECT s1, r, round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 5) + 0.0 AS logit2a, rank2a, round(p_best, 6) AS p_best, n_above50::BIGINT AS n_above50, round(sum_p, 6) AS sum_p, round(p_best - p, 6) AS gap_best,
round(coalesce(max(CASE WHEN rank2a = 2 THEN p END) OVER (PARTITION BY s1), 0), 6) AS p_second, round(p / greatest(p_best, 1e-6), 6) AS rel_best FROM gc"""))
def group_context_columnar(spark, sf_dir):
    g = feat.columnar_context(scored_pairs(spark, sf_dir), "p")
    g = rounded(longs(g, "rank2a", "n_above50"), "p_best", "sum_p", "gap_best", "p_second", "rel_best").withColumn("logit2a", F.round("logit2a", 5) + 0.0)
    return g.select("s1", "r", "logit2a", "rank2a", "p_best", "n_above50", "sum_p", "gap_best", "p_second", "rel_best")


EXCL = "ex AS (SELECT s1, r, p, row_number() OVER (PARTITION BY r ORDER BY p DESC, s1) AS n, max(p) OVER (PARTITION BY r) AS best FROM (SELECT s1, r, round(p, 9) AS p FROM pairs))"


@query(o.query(o.RECORDS, o.PAIRS, EXCL, body="SELECT s1, r, round(CASE WHEN n = 1 THEN p WHEN best - p >= 0.2 THEN 0 ELSE p * 0.5 END, 6) AS p FROM ex"))
def exclusivity_soft(spark, sf_dir):
    return rounded(decide.exclusivity(scored_pairs(spark, sf_dir)), "p")


@query(o.query(o.RECORDS, o.PAIRS, EXCL, body="SELECT s1, r, round(CASE WHEN n = 1 THEN p ELSE 0 END, 6) AS p FROM ex"))
def exclusivity_hard(spark, sf_dir):
    return rounded(decide.exclusivity(scored_pairs(spark, sf_dir), hard=True), "p")


RK = "rkd AS (SELECT s1, r, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, r) AS rk FROM (SELECT s1, r, round(p, 9) AS p FROM pairs))"


@query(o.query(o.RECORDS, o.PAIRS, RK, body="SELECT s1, r, rule FROM (SELECT s1, r, 'global' AS rule FROM rkd WHERE p >= 0.5 UNION ALL SELECT s1, r, 'top1' FROM rkd WHERE rk = 1 AND p >= 0.5)"))
def global_and_top1_threshold(spark, sf_dir):
    p = scored_pairs(spark, sf_dir)
    rows = lambda df, rule: df.select("s1", "r", F.lit(rule).alias("rule"))
    return rows(decide.global_threshold(p), "global").unionByName(rows(decide.top1_threshold(p), "top1"))


@query(o.query(o.RECORDS, o.PAIRS, RK, body="SELECT s1, r FROM (SELECT s1, r, min((p >= CASE WHEN rk = 1 THEN 0.3 ELSE 0.4 END)::INT) OVER (PARTITION BY s1 ORDER BY rk) AS ok FROM rkd) WHERE ok = 1"))
def two_threshold(spark, sf_dir):
    return decide.two_thresholds(scored_pairs(spark, sf_dir), first=0.3, extra=0.4).select("s1", "r")


@query(o.query(o.RECORDS, o.PAIRS, RK, """mf AS (SELECT s1, r, rk, sum(p) OVER (PARTITION BY s1 ORDER BY rk) AS cum, sum(p) OVER (PARTITION BY s1) AS total, exp(sum(ln(greatest(1 - p, 1e-300))) OVER (PARTITION BY s1)) AS none FROM rkd WHERE rk <= 20),
mv AS (SELECT *, round(5 * cum / (4 * rk + total), 12) AS v FROM mf), mb AS (SELECT *, max(v) OVER (PARTITION BY s1) AS best FROM mv),
mk AS (SELECT *, min(CASE WHEN v = best THEN rk END) OVER (PARTITION BY s1) AS k FROM mb)""", body="SELECT s1, r FROM mk WHERE rk <= k AND none < best"))
def expected_f_meanfield(spark, sf_dir):
    return decide.expected_f05_meanfield(scored_pairs(spark, sf_dir)).select("s1", "r")


# The chances of 0 to 3 missed links, their mean being 0.03.
MISSED = "miss AS (SELECT j, w / sum(w) OVER () AS w FROM (SELECT unnest(range(0, 4)) AS j, exp(-0.03) * pow(0.03, unnest(range(0, 4))) / [1, 1, 2, 6][unnest(range(1, 5))] AS w))"


@query("WITH RECURSIVE " + ",\n".join((o.RECORDS, o.PAIRS, RK, MISSED)) + """,
q AS (SELECT s1, r, rk, greatest(1e-7, least(1 - 1e-7, p)) AS p, least(max(rk) OVER (PARTITION BY s1), 14) AS n FROM rkd WHERE rk <= 14 AND p > 1e-6),
heads(s1, k, pmf) AS (SELECT DISTINCT s1, 0::BIGINT, [1.0::DOUBLE] FROM q UNION ALL
  SELECT h.s1, q.rk, list_transform(list_zip(list_append(list_transform(h.pmf, lambda x: x * (1 - q.p)), 0.0), list_prepend(0.0, list_transform(h.pmf, lambda x: x * q.p))), lambda z: z[1] + z[2]) FROM heads h JOIN q ON q.s1 = h.s1 AND q.rk = h.k + 1),
tails(s1, k, pmf) AS (SELECT DISTINCT s1, n::BIGINT, [1.0::DOUBLE] FROM q UNION ALL
  SELECT t.s1, q.rk - 1, list_transform(list_zip(list_append(list_transform(t.pmf, lambda x: x * (1 - q.p)), 0.0), list_prepend(0.0, list_transform(t.pmf, lambda x: x * q.p))), lambda z: z[1] + z[2]) FROM tails t JOIN q ON q.s1 = t.s1 AND q.rk = t.k),
inside AS (SELECT s1, k, unnest(range(0, len(pmf))) AS a, unnest(pmf) AS pa FROM heads),
outside AS (SELECT s1, k, c + j AS c, sum(pc * w) AS pc FROM (SELECT s1, k, unnest(range(0, len(pmf))) AS c, unnest(pmf) AS pc FROM tails) CROSS JOIN miss GROUP BY s1, k, c + j),
worth AS (SELECT s1, k, sum(pa * pc * 5.0 * a / (4 * k + a + c)) AS v FROM inside JOIN outside USING (s1, k) WHERE a >= 1 GROUP BY s1, k UNION ALL SELECT s1, k, sum(pc) FROM outside WHERE k = 0 AND c = 0 GROUP BY s1, k),
pick AS (SELECT s1, k FROM (SELECT s1, k, row_number() OVER (PARTITION BY s1 ORDER BY round(v, 11) DESC, k) AS n FROM worth) WHERE n = 1)
SELECT q.s1, q.r FROM q JOIN pick ON pick.s1 = q.s1 AND q.rk <= pick.k""")
def expected_f_exact(spark, sf_dir):
    return decide.expected_f05(scored_pairs(spark, sf_dir)).select("s1", "r")


@query("WITH RECURSIVE " + ",\n".join((o.RECORDS, o.PAIRS, RK)) + """,
tail(s1, rk, pmf) AS (SELECT DISTINCT s1, 0::BIGINT, [1.0::DOUBLE] FROM rkd UNION ALL
  SELECT t.s1, r.rk, list_transform(list_zip(list_append(list_transform(t.pmf, lambda x: x * (1 - r.p)), 0.0), list_prepend(0.0, list_transform(t.pmf, lambda x: x * r.p))), lambda z: z[1] + z[2]) FROM tail t JOIN rkd r ON r.s1 = t.s1 AND r.rk = t.rk + 1)
SELECT s1, i::BIGINT - 1 AS k, round(pmf[i], 6) AS prob FROM (SELECT s1, pmf, unnest(range(1, len(pmf) + 1)) AS i FROM (SELECT *, max(rk) OVER (PARTITION BY s1) AS last FROM tail) WHERE rk = last)""")
def match_count_distribution(spark, sf_dir):
    ps = scored_pairs(spark, sf_dir).groupBy("s1").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("p"), "r")), asc=False), lambda x: x["p"]).alias("ps"))
    return ps.select("s1", F.posexplode(decide.count_distribution(F.col("ps"))).alias("k", "prob")).select("s1", F.col("k").cast("long").alias("k"), F.round("prob", 6).alias("prob"))


@query(o.query(o.RECORDS, o.PAIRS, body="SELECT s1, r FROM (SELECT pairs.s1, r, row_number() OVER (PARTITION BY r ORDER BY s.row_ord, pairs.s1) AS n FROM pairs JOIN s ON s.entity_id = pairs.s1 WHERE round(p, 9) >= 0.3) WHERE n = 1"))
def first_come_exclusivity(spark, sf_dir):
    order = sides(spark, sf_dir)[0].select(F.col("entity_id").alias("s1"), "row_ord")
    return decide.first_come(decide.global_threshold(scored_pairs(spark, sf_dir), threshold=0.3).join(order, "s1")).select("s1", "r")


@query(o.query(o.RECORDS, o.PAIRS, RK, body="SELECT s1, array_to_string(list_transform(list(p ORDER BY rk), lambda x: printf('%.6f', x)), ' ') AS ps FROM rkd WHERE rk <= 20 GROUP BY s1"))
def probability_lists(spark, sf_dir):
    lists = decide.probability_lists(scored_pairs(spark, sf_dir))
    return lists.select("s1", F.array_join(F.transform("ps", lambda x: F.format_string("%.6f", x)), " ").alias("ps"))


@query(o.query(o.RECORDS, body="SELECT country_norm, count(*) AS n FROM rec WHERE country_norm <> '' GROUP BY country_norm"))
def country_counts(spark, sf_dir):
    return tables.countries(canonicalize(raw_records(spark, sf_dir)))


# Evaluation.

CHOSEN = "chosen AS (SELECT s1, r FROM pairs WHERE round(p, 9) >= 0.5)"


def chosen(spark, sf_dir) -> DataFrame:
    return decide.global_threshold(scored_pairs(spark, sf_dir)).select("s1", "r")


def evaluated(spark, sf_dir) -> DataFrame:
    return metrics.per_entity(entities(spark, sf_dir), chosen(spark, sf_dir), gold_links(spark, sf_dir))


@query(o.query(o.VIEW, o.GOLD, body="SELECT s1, r FROM gold"))
def gold_long(spark, sf_dir):
    return gold_links(spark, sf_dir)


EVAL = (o.RECORDS, o.PAIRS, o.GOLD, CHOSEN, o.scored("chosen"))


@query(o.query(*EVAL, body="SELECT s1, p, g, tp, round(f05, 6) AS f05 FROM per"))
def f05_entity(spark, sf_dir):
    return rounded(evaluated(spark, sf_dir), "f05").select("s1", "p", "g", "tp", "f05")


@query(o.query(*EVAL, body="SELECT round(avg(f05), 6) AS macro_f05, round(coalesce(avg(f05) FILTER (g = 0), 0), 6) AS singleton_accuracy, round(coalesce(avg(f05) FILTER (g > 0), 0), 6) AS non_singleton_f05, count(*) AS n, count(*) FILTER (g = 0) AS n_singletons FROM per"))
def f05_macro(spark, sf_dir):
    return rounded(metrics.macro(evaluated(spark, sf_dir)), "macro_f05", "singleton_accuracy", "non_singleton_f05")


@query(o.query(*EVAL, body="""SELECT round(avg((p = 0)::INT) FILTER (g = 0), 6) AS singleton_accuracy, round(1 - avg((p = 0)::INT) FILTER (g = 0), 6) AS singleton_false_positive_rate,
round(coalesce(avg((p = 0)::INT) FILTER (g > 0), 0), 6) AS non_singleton_abstention_rate, count(*) FILTER (g = 0) AS n_singletons, count(*) FILTER (g > 0) AS n_non_singletons FROM per"""))
def singleton_metrics(spark, sf_dir):
    return rounded(metrics.singletons(evaluated(spark, sf_dir)), "singleton_accuracy", "singleton_false_positive_rate", "non_singleton_abstention_rate")


@query(o.query(o.RECORDS, o.PAIRS, o.GOLD, o.scored("pairs"), body="""SELECT round(sum(tp) / sum(g), 6) AS pair_completeness, round(1.0 - sum(p) / ((SELECT count(*) FROM s)::DOUBLE * (SELECT count(*) FROM p)), 6) AS reduction_ratio, round(avg((tp = g)::INT), 6) AS entity_recall,
round(avg(CASE WHEN g = 0 THEN 1.0 ELSE 5.0 * tp / (4.0 * tp + g) END), 6) AS ceiling_f05, round(avg(p), 6) AS mean_candidates, round(quantile_cont(p, 0.5), 6) AS p50_candidates, round(quantile_cont(p, 0.99), 6) AS p99_candidates, max(p) AS max_candidates FROM per"""))
def blocking_metrics(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    q = metrics.blocking_quality(entities(spark, sf_dir), overlap_pairs(spark, sf_dir), gold_links(spark, sf_dir), s1.count(), pool.count())
    return rounded(q, "pair_completeness", "reduction_ratio", "entity_recall", "ceiling_f05", "mean_candidates", "p50_candidates", "p99_candidates")


@query(o.query(o.RECORDS, o.PAIRS, o.GOLD, o.ENTITIES, body="""SELECT country_norm, count(*) AS n_gold, count(pairs.r) AS n_found, round(count(pairs.r)::DOUBLE / count(*), 6) AS recall
FROM gold JOIN ent ON gold.s1 = ent.s1 LEFT JOIN pairs ON pairs.s1 = gold.s1 AND pairs.r = gold.r WHERE gold.s1 IN (SELECT s1 FROM pairs) GROUP BY country_norm"""))
def recall_by_country(spark, sf_dir):
    return rounded(metrics.recall_by(entities(spark, sf_dir), overlap_pairs(spark, sf_dir), gold_links(spark, sf_dir), "country_norm"), "recall")


@query("WITH " + HITS + ",\n" + o.GOLD + "\nSELECT channel, count(*) AS n_found, round(count(*)::DOUBLE / (SELECT count(*) FROM gold), 6) AS recall FROM found JOIN gold USING (s1, r) GROUP BY channel")
def channel_recall(spark, sf_dir):
    return rounded(metrics.channel_recall(ch_hits(spark, sf_dir), gold_links(spark, sf_dir)), "recall")


@query(o.query(*EVAL, body="SELECT country_norm, count(*) AS n, sum(p - tp)::BIGINT AS false_positives, sum(g - tp)::BIGINT AS false_negatives, round(avg(f05), 6) AS macro_f05 FROM per GROUP BY country_norm"))
def error_profile(spark, sf_dir):
    return rounded(metrics.error_profile(chosen(spark, sf_dir), gold_links(spark, sf_dir), entities(spark, sf_dir), "country_norm"), "macro_f05")


@query(o.query(o.RECORDS, o.PAIRS, o.GOLD, CHOSEN, """w AS (SELECT coalesce(c.s1, g.s1) AS s1, coalesce(c.r, g.r) AS r, c.s1 IS NOT NULL AS wrong FROM chosen c FULL JOIN gold g ON c.s1 = g.s1 AND c.r = g.r WHERE c.s1 IS NULL OR g.s1 IS NULL),
wj AS (SELECT w.*, EXISTS (SELECT 1 FROM pairs q WHERE q.s1 = w.s1 AND q.r = w.r) AS cand, w.s1 IN (SELECT s1 FROM gold) AS linked, a.name_core AS ca, b.name_core AS cb, a.house_no AS ha, b.house_no AS hb, a.addr_norm AS aa, b.addr_norm AS ab FROM w LEFT JOIN rec a ON a.entity_id = w.s1 LEFT JOIN rec b ON b.entity_id = w.r)""",
    body="""SELECT s1, r, 'blocking_miss' AS tag FROM wj WHERE NOT wrong AND NOT cand UNION ALL SELECT s1, r, 'decision_miss' FROM wj WHERE NOT wrong AND cand UNION ALL SELECT s1, r, 'false_positive' FROM wj WHERE wrong
UNION ALL SELECT s1, r, 'singleton_violation' FROM wj WHERE wrong AND NOT linked UNION ALL SELECT s1, r, 'branch_confusion' FROM wj WHERE wrong AND ca <> '' AND ca = cb AND ha <> '' AND hb <> '' AND ha <> hb
UNION ALL SELECT s1, r, 'colocation_confusion' FROM wj WHERE wrong AND aa <> '' AND aa = ab AND ca <> cb"""))
def error_tags(spark, sf_dir):
    rec = canonicalize(raw_records(spark, sf_dir))
    return metrics.error_tags(chosen(spark, sf_dir), overlap_pairs(spark, sf_dir), gold_links(spark, sf_dir), rec, rec)


@query(o.query(o.RECORDS, o.PAIRS, o.GOLD, CHOSEN, """bad AS (SELECT c.s1, c.r, 'false_positive' AS tag FROM chosen c LEFT JOIN gold g ON g.s1 = c.s1 AND g.r = c.r WHERE g.s1 IS NULL
UNION ALL SELECT c.s1, c.r, 'singleton_violation' FROM chosen c WHERE c.s1 NOT IN (SELECT s1 FROM gold))""",
    body="""SELECT tag, s1, r, a.business_name AS name_a, b.business_name AS name_b, a.business_address AS addr_a, b.business_address AS addr_b FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY s1, r) AS n FROM bad)
JOIN rec a ON a.entity_id = s1 JOIN rec b ON b.entity_id = r WHERE n <= 5"""))
def error_examples(spark, sf_dir):
    """The first five wrong pairs of two kinds, with what their records say."""
    rec = canonicalize(raw_records(spark, sf_dir))
    tags = metrics.error_tags(chosen(spark, sf_dir), overlap_pairs(spark, sf_dir), gold_links(spark, sf_dir), rec, rec)
    return metrics.error_examples(tags.where("tag in ('false_positive', 'singleton_violation')"), rec, rec)


@query(o.query(o.RECORDS, o.PAIRS, o.GOLD, o.ENTITIES, """gs AS (SELECT ent.s1, count(gold.r) AS g FROM ent LEFT JOIN gold USING (s1) GROUP BY ent.s1), grid AS (SELECT unnest(range(5, 96)) / 100.0 AS x0),
lab AS (SELECT pairs.s1, round(p, 9) AS p, (gold.r IS NOT NULL)::INT AS y FROM pairs LEFT JOIN gold ON gold.s1 = pairs.s1 AND gold.r = pairs.r),
res AS (SELECT x0, gs.s1, g, count(lab.p) FILTER (lab.p >= x0) AS k, coalesce(sum(y) FILTER (lab.p >= x0), 0) AS tp FROM gs CROSS JOIN grid LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC) AS rk FROM lab) WHERE rk <= 20) lab USING (s1) GROUP BY x0, gs.s1, g)""",
    body="SELECT round(x0, 3)::DOUBLE AS x0, round(avg(CASE WHEN g = 0 THEN (k = 0)::INT ELSE 5.0 * tp / (4.0 * k + g) END), 6) AS macro_f05 FROM res GROUP BY x0"))
def threshold_sweep(spark, sf_dir):
    y = gold_links(spark, sf_dir).withColumn("y", F.lit(1))
    pairs = scored_pairs(spark, sf_dir).join(y, ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    sizes = entities(spark, sf_dir).join(y.groupBy(F.col("s1").alias("_s")).agg(F.count("*").alias("g")), F.col("s1") == F.col("_s"), "left").select("s1", F.coalesce("g", F.lit(0)).alias("g"))
    return rounded(decide.sweep(pairs, sizes, "global", decide.grids()["global"]), "x0", "macro_f05")


@query(o.query(o.RECORDS, o.GOLD, body="""SELECT (SELECT coalesce(max(n), 0) <= 1 FROM (SELECT count(*) AS n FROM gold GROUP BY r)) AS g1_exclusive, round(avg((trim(lower(a.country)) = trim(lower(b.country)))::INT), 6) AS same_country_rate, round(avg((b.postal <> '')::INT), 6) AS postal_rate,
round((SELECT count(*) FILTER (n > 1)::DOUBLE / count(*) FROM (SELECT count(*) AS n FROM gold GROUP BY s1)), 6) AS multi_match_share, round((SELECT avg((entity_id NOT IN (SELECT s1 FROM gold))::INT) FROM s), 6) AS singleton_rate
FROM gold JOIN rec a ON a.entity_id = gold.s1 JOIN rec b ON b.entity_id = gold.r"""))
def decision_gates(spark, sf_dir):
    rec = canonicalize(raw_records(spark, sf_dir))
    g = checks.decision_gates(rec, rec, gold_links(spark, sf_dir), entities(spark, sf_dir))
    return rounded(g, "same_country_rate", "postal_rate", "multi_match_share", "singleton_rate").select("g1_exclusive", "same_country_rate", "postal_rate", "multi_match_share", "singleton_rate")


@query(o.query(o.VIEW, body="""SELECT count(*) AS rows, count(*) FILTER (trim(entity_id) = '') AS empty_ids, count(entity_id) - count(DISTINCT entity_id) AS repeated_ids, count(*) FILTER (NOT starts_with(entity_id, source || '-')) AS wrong_prefixes,
count(*) FILTER (trim(business_name) = '') AS empty_names, count(*) FILTER (trim(business_address) = '') AS empty_addresses, count(*) FILTER (trim(country) = '') AS empty_countries, count(*) FILTER (regexp_matches(business_name || ' ' || business_address, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS control_characters FROM view_raw"""))
def validate_records(spark, sf_dir):
    return checks.record_report(raw_records(spark, sf_dir))


# Calibration figures on labelled documents: a score from the lengths, which are whole numbers in both engines.
LABELLED = "lb AS (SELECT toxic AS y, (n_chars % 1000) / 1000.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"


def labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("toxic").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("p"))


@query(o.query(LABELLED, body="SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM lb GROUP BY 1"))
def ece_bins(spark, sf_dir):
    return rounded(longs(metrics.calibration_bins(labelled(spark, sf_dir)), "bin"), "mean_p", "mean_y")


@query(o.query(LABELLED, "bn AS (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS my FROM lb GROUP BY least(floor(p * 10), 9))", body="""SELECT round((SELECT sum(n * abs(mp - my)) / sum(n) FROM bn), 6) AS ece, round(avg((p - y) * (p - y)), 6) AS brier,
round(avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))), 6) AS log_loss FROM lb"""))
def brier_logloss(spark, sf_dir):
    df = labelled(spark, sf_dir)
    e = metrics.ece(df).first().ece
    return rounded(metrics.losses(df).withColumn("ece", F.lit(e)), "ece", "brier", "log_loss").select("ece", "brier", "log_loss")


@query(o.query(LABELLED, "rnk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM lb)", body="SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 6) AS auc FROM rnk"))
def auc_ranksum(spark, sf_dir):
    return rounded(metrics.auc(labelled(spark, sf_dir)), "auc")


@query()
def bootstrap_difference(spark, sf_dir):
    other = decide.two_thresholds(scored_pairs(spark, sf_dir), first=0.3, extra=0.4).select("s1", "r")
    e, g = entities(spark, sf_dir), gold_links(spark, sf_dir)
    found = metrics.bootstrap_difference(metrics.per_entity(e, chosen(spark, sf_dir), g), metrics.per_entity(e, other, g))
    return spark.createDataFrame([(float(found["observed_mean_delta"]), float(found["ci_lower"]), float(found["ci_upper"]), float(found["p_value"]), bool(found["significant"]))], "observed_mean_delta double, ci_lower double, ci_upper double, p_value double, significant boolean")


def _abbreviates(a: str, b: str) -> str:
    """SQL: whether the shorter of two tokens (the first, if they are as long) abbreviates the other."""
    bones = "regexp_replace({}, '[^b-df-hj-np-tv-z]', '', 'g')"
    rule = "(length({s}) >= 2 AND (starts_with({l}, {s}) OR contains(" + bones.format("{l}") + ", {s})) OR length({s}) <= 4 AND {s}[1] = {l}[1] AND regexp_matches({l}, array_to_string(string_split({s}, ''), '.*')))"
    return f"({a} <> '' AND {b} <> '' AND {a} <> {b} AND CASE WHEN length({a}) <= length({b}) THEN {rule.format(s=a, l=b)} ELSE {rule.format(s=b, l=a)} END)"


@query(o.query("""nm AS (SELECT p_partkey, string_split(p_name, ' ') AS a, list_transform(string_split(p_name, ' '), lambda w: CASE WHEN length(w) > 4 THEN w[1:3] ELSE w END) AS b FROM part)""",
    "prs AS (SELECT x.a AS a, x.b AS b, true AS good FROM nm x UNION ALL SELECT x.a, y.b, false FROM nm x JOIN nm y ON y.p_partkey = x.p_partkey + 1)",
    "tk AS (SELECT good, unnest(list_distinct(list_filter(a, lambda w: NOT list_contains(b, w)))) AS x, list_distinct(list_filter(b, lambda w: NOT list_contains(a, w))) AS ys FROM prs)",
    "xy AS (SELECT good, least(x, y) AS x, greatest(x, y) AS y FROM (SELECT good, x, unnest(ys) AS y FROM tk))",
    f"ct AS (SELECT x, y, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS m FROM xy GROUP BY x, y HAVING count(*) FILTER (good) > 0 AND {_abbreviates('x', 'y')})",
    body="SELECT CASE WHEN length(x) < length(y) THEN x ELSE y END AS short, CASE WHEN length(x) < length(y) THEN y ELSE x END AS long, n AS count, round(n::DOUBLE / (n + m), 6) AS precision FROM ct WHERE n >= 5 AND n::DOUBLE / (n + m) >= 0.5"))
def mined_abbreviations(spark, sf_dir):
    """Abbreviations of part names: of their own, and of those of the next part, which are no match."""
    words = F.split("p_name", " ")
    cut = F.transform(words, lambda w: F.when(F.length(w) > 4, F.substring(w, 1, 3)).otherwise(w))
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.array_join(cut, " ").alias("b"))
    after = names.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("b"))
    found = feat.abbreviations(names.select("a", "b"), names.select("p_partkey", "a").join(after, "p_partkey").select("a", "b"), min_precision=0.5)
    return rounded(longs(found, "count"), "precision")


@query(SIM.replace("{}", """regexp_replace(lower(a), '[^b-df-hj-np-tv-z]', '', 'g') AS skeleton, round(CASE WHEN len(ua) = 0 OR len(ub) = 0 THEN 0 ELSE len(list_filter(CASE WHEN len(ua) <= len(ub) THEN ua ELSE ub END,
lambda s: len(list_filter(CASE WHEN len(ua) <= len(ub) THEN ub ELSE ua END, lambda t: """ + _abbreviates("s", "t") + """)) > 0))::DOUBLE / least(len(ua), len(ub)) END, 6) AS aligned""").replace(" FROM x", """ FROM (SELECT *,
list_filter(list_distinct(list_filter(ta, lambda w: NOT list_contains(tb, w))), lambda w: length(w) >= 2) AS ua, list_filter(list_distinct(list_filter(tb, lambda w: NOT list_contains(ta, w))), lambda w: length(w) >= 2) AS ub FROM x)"""))
def abbreviation_alignment(spark, sf_dir):
    """Consonant skeletons, and the share of unshared tokens that abbreviate another's."""
    pairs = named_pairs(spark, sf_dir)
    return rounded(pairs.select("s1", "r", t.skeleton(F.col("a_name_core")).alias("skeleton"), t.abbreviation_alignment(F.col("a_name_core_tokens"), F.col("b_name_core_tokens")).alias("aligned")), "aligned")


# Files, samples and checks of results.

FLAT = lambda c: f"regexp_replace(coalesce({c}, ''), '[\\t\\r\\n]+', ' ', 'g') AS {c}"


def files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the registry's records and links as tab-separated files, as a run reads them."""
    folder = f"{scratch(spark)}/entwine-files-{uuid.uuid4().hex}"
    raw = raw_records(spark, sf_dir).select("*", *(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\\t\\r\\n]+", " ").alias(f"_{c}") for c in tables.RECORD.names))

    def put(rows: DataFrame, name: str, header) -> None:
        head = spark.createDataFrame([("\t".join(header),)], "value string")
        head.coalesce(1).union(rows).write.text(f"{folder}/{name}")

    for k in (1, 2, 3):
        put(raw.where(F.col("source") == f"S{k}").select(F.concat_ws("\t", *(f"_{c}" for c in tables.RECORD.names)).alias("value")), f"source{k}.tsv", tables.RECORD.names)
    entities = raw.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "row_ord")
    lists = tables.as_lists(entities, gold_links(spark, sf_dir), tables.MATCHING_HEADER)
    put(lists.select(F.concat_ws("\t", *tables.MATCHING_HEADER).alias("value")), "ground_truth.tsv", tables.MATCHING_HEADER)
    return folder


def read_back(spark, sf_dir) -> list[DataFrame]:
    folder = files(spark, sf_dir)
    return [tables.read_records(spark, f"{folder}/source{k}.tsv", f"S{k}") for k in (1, 2, 3)]


@query(o.query(o.VIEW, body=f"SELECT entity_id, {FLAT('business_name')}, {FLAT('business_address')}, country, source, 'train' AS split FROM view_raw"))
def scan_records(spark, sf_dir):
    """Every record, written to tab-separated files and read again."""
    a, b, c = read_back(spark, sf_dir)
    return a.unionByName(b).unionByName(c).drop("row_ord")


@query(o.query(o.VIEW, o.GOLD, body="SELECT a.entity_id AS s1, r FROM view_raw a LEFT JOIN (SELECT DISTINCT s1, r FROM gold) ON s1 = a.entity_id WHERE source = 'S1'"))
def scan_links(spark, sf_dir):
    """Every entity with its links from a list file, or none."""
    entities, gold = tables.read_links(spark, f"{files(spark, sf_dir)}/ground_truth.tsv")
    return entities.join(gold, "s1", "left").select("s1", "r")


@query(o.query(o.VIEW, body="SELECT entity_id, (source = 'S3')::INT AS is_s3 FROM view_raw WHERE source <> 'S1'"))
def scan_pool(spark, sf_dir):
    _, second, third = read_back(spark, sf_dir)
    return tables.pool(second, third).select("entity_id", "is_s3")


@query(o.query(o.VIEW, body="SELECT entity_id, country FROM view_raw WHERE row_ord % 7 <> 0"))
def scan_malformed(spark, sf_dir):
    """Rows with too few fields are left out; a byte-order mark is no part of the header."""
    folder = f"{scratch(spark)}/entwine-files-{uuid.uuid4().hex}"
    raw = raw_records(spark, sf_dir)
    line = F.when(F.col("row_ord") % 7 == 0, F.concat_ws("\t", "entity_id", F.lit("lost"))).otherwise(F.concat_ws("\t", "entity_id", F.lit('"name'), F.lit("NA"), "country"))
    spark.createDataFrame([("\ufeff" + "\t".join(tables.RECORD.names),)], "value string").coalesce(1).union(raw.select(line.alias("value"))).write.text(folder)
    return tables.read_records(spark, folder, "S1", malformed="drop").select("entity_id", "country")


@query(o.query(o.RECORDS, body="SELECT entity_id, name_norm, source, country_norm FROM rec WHERE source IN ('S2', 'S3') AND country_norm = 'en'"))
def scan_normalised(spark, sf_dir):
    """Normalised records by split, source and country, written and read with pruning."""
    path = f"{scratch(spark)}/entwine-files-{uuid.uuid4().hex}"
    tables.write_normalised(canonicalize(raw_records(spark, sf_dir)).withColumn("split", F.lit("train")), path)
    return tables.read_normalised(spark, path, "train", ["S2", "S3"], "en", ["entity_id", "name_norm", "source", "country_norm"])


@query(o.query(o.RECORDS, o.PAIRS, body="""SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids, n AS nth FROM (SELECT entity_id, row_number() OVER (ORDER BY row_ord) AS n FROM rec WHERE source = 'S1')
LEFT JOIN (SELECT s1, string_agg(r, ',' ORDER BY r) AS ids FROM (SELECT DISTINCT s1, r FROM pairs WHERE round(p, 9) >= 0.5) GROUP BY s1) ON s1 = entity_id"""))
def result_lists(spark, sf_dir):
    """Results written under their contract and read again: one line per entity, in order."""
    folder = f"{scratch(spark)}/entwine-files-{uuid.uuid4().hex}"
    raw = raw_records(spark, sf_dir)
    entities = raw.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "row_ord")
    # The checks and both files read the pairs several times: they are found once.
    pairs = stored(overlap_pairs(spark, sf_dir))
    tables.write_results(entities, pairs, decide.global_threshold(pairs.select("s1", "r", F.round("p", 9).alias("p"))).select("s1", "r"), folder, raw.where("source <> 'S1'"))
    rows = tables.read_tsv(spark, f"{folder}/matching_results", tables.MATCHING_HEADER)
    return rows.withColumn("nth", F.row_number().over(Window.orderBy("row_ord")).cast("long")).drop("row_ord")


@query(o.query(o.VIEW, o.GOLD, """e AS (SELECT entity_id AS s1, row_number() OVER (ORDER BY row_ord) AS n FROM view_raw WHERE source = 'S1'), pt AS (SELECT s1, CASE WHEN n <= 5 THEN 'val' ELSE 'train' END AS part FROM e WHERE n <= 15),
fr AS (SELECT entity_id, row_number() OVER (ORDER BY row_ord) AS n FROM view_raw WHERE source <> 'S1' AND entity_id NOT IN (SELECT r FROM gold))""",
    body="""SELECT part, 'entity' AS kind, s1 AS id FROM pt UNION ALL SELECT part, 'gold', s1 || ' ' || r FROM gold JOIN pt USING (s1) UNION ALL SELECT DISTINCT part, 'pool', r FROM gold JOIN pt USING (s1)
UNION ALL SELECT CASE WHEN n <= 10 THEN 'val' ELSE 'train' END, 'pool', entity_id FROM fr WHERE n <= 20"""))
def cohort_rows(spark, sf_dir):
    """A validation and a training cohort: entities, their links, and their pools with distractors."""
    raw = raw_records(spark, sf_dir)
    c = tables.cohort(raw.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "row_ord"), gold_links(spark, sf_dir), raw.where("source <> 'S1'"), 5, 10, 20)
    out = None
    for part in ("val", "train"):
        for kind, df, label in (("entity", "entities", F.col("s1")), ("gold", "gold", F.concat_ws(" ", "s1", "r")), ("pool", "pool", F.col("entity_id"))):
            rows = c[f"{part}_{df}"].select(F.lit(part).alias("part"), F.lit(kind).alias("kind"), label.alias("id"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query(o.query(o.RECORDS, o.PAIRS, o.GOLD, """lk AS (SELECT DISTINCT r FROM gold)""", body="SELECT count(*) AS n, count(*) FILTER (linked) AS n_kept FROM (SELECT entity_id, entity_id IN (SELECT r FROM lk) AS linked FROM rec WHERE source <> 'S1') WHERE linked OR 1 = 0"))
def linked_sample(spark, sf_dir):
    """A keyed sample without further rows: all records that links name."""
    raw = raw_records(spark, sf_dir).where("source <> 'S1'")
    linked = gold_links(spark, sf_dir).select(F.col("r").alias("entity_id")).distinct()
    found = tables.keyed_sample(raw, linked, 0).join(linked.withColumn("linked", F.lit(True)), "entity_id", "left")
    return found.agg(F.count("*").alias("n"), F.count("linked").alias("n_kept"))


@query(o.query(o.RECORDS, o.PAIRS, body="""SELECT count(*) FILTER (row_ord % 5 = 0) AS bad_prefixes, count(*) FILTER (row_ord % 5 = 0) AS unknown_ids, count(*) FILTER (row_ord % 3 = 0) AS repeated_pairs, 0::BIGINT AS outside_candidates, count(*) AS n_entities FROM rec WHERE source = 'S1'"""))
def output_findings(spark, sf_dir):
    """Counts of planted faults: entities among the candidates, and some pairs twice."""
    raw = raw_records(spark, sf_dir)
    s1 = raw.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "row_ord")
    first = raw.where("source <> 'S1'").agg(F.min("entity_id").alias("r")).first().r
    pairs = overlap_pairs(spark, sf_dir).select("s1", "r").where(F.col("r") != first)
    twice = s1.where("row_ord % 3 = 0").select("s1", F.lit(first).alias("r"))
    wrong = s1.where("row_ord % 5 = 0").select("s1", F.col("s1").alias("r"))
    found = checks.output_report(twice.limit(0), pairs.unionByName(twice).unionByName(twice).unionByName(wrong), s1, raw.where("source <> 'S1'"))
    return longs(found, *found.columns)


@query(o.query(o.VIEW, """f AS (SELECT row_ord % 6 AS k, count(*) AS n FROM view_raw WHERE source = 'S1' GROUP BY 1)""", body="""SELECT CASE k WHEN 0 THEN 'missing_entity' WHEN 1 THEN 'repeated_row' WHEN 2 THEN 'repeated_id' WHEN 3 THEN 'self_match' WHEN 4 THEN 'wrong_prefix' END AS finding, sum(n)::BIGINT AS n FROM f WHERE k < 5 GROUP BY 1
UNION ALL SELECT 'malformed_row', 1 UNION ALL SELECT 'extra_entity', 1 UNION ALL SELECT 'unknown_id', 1"""))
def list_file_findings(spark, sf_dir):
    """What a result file with planted faults is told."""
    raw = raw_records(spark, sf_dir)
    s1 = raw.where("source = 'S1'")
    valid = raw.where("source <> 'S1'").select("entity_id")
    good = valid.agg(F.min("entity_id").alias("x")).first().x
    k = F.col("row_ord") % 6
    ids = F.when(k == 2, F.lit(f"{good},{good}")).when(k == 3, F.lit("S1-0")).when(k == 4, F.lit("X-1")).otherwise(F.lit(""))
    line = F.concat("entity_id", F.lit("\t"), ids)
    rows = s1.where(k != 0).select(F.explode(F.when(k == 1, F.array(line, line)).otherwise(F.array(line))).alias("value"))
    extra = spark.createDataFrame([("\t".join(tables.MATCHING_HEADER),), ("S1-none\tS2-none",), ("too\tmany\tfields",)], "value string")
    path = f"{scratch(spark)}/entwine-files-{uuid.uuid4().hex}"
    extra.coalesce(1).union(rows).write.text(path)
    return checks.check_list_file(spark, path, tables.MATCHING_HEADER, s1.select(F.col("entity_id").alias("s1")), valid).select("finding", "n")


@query()
def synthetic_records(spark, sf_dir):
    """The synthetic registry: its entities and the noisy records made of them."""
    s1, pool, _ = synthetic.registry(spark, 200, seed=42)
    columns = ["entity_id", "business_name", "business_address", "country"]
    return s1.select(*columns).unionByName(pool.select(*columns))


# Learning: a run's cascade, cross-fitted on the registry's pairs.


@query()
def hard_negative_weights(spark, sf_dir):
    y = gold_links(spark, sf_dir).withColumn("y", F.lit(1))
    df = full_features(spark, sf_dir).join(y, ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return learn.hard_negative_weight(df).select("s1", "r", "y", "weight", learn.fold_of(F.col("s1"), 5).alias("fold"))


@query()
def matcher_out_of_fold(spark, sf_dir):
    """Selected pairs of the two-stage matcher, trained with the settings of a run, each scored by the fold that has not seen it."""
    c = Config()
    gold = gold_links(spark, sf_dir)
    sizes = entities(spark, sf_dir).join(gold.groupBy(F.col("s1").alias("_s")).agg(F.count("*").alias("g")), F.col("s1") == F.col("_s"), "left").select("s1", F.coalesce("g", F.lit(0)).alias("g"))
    features = stored(full_features(spark, sf_dir))
    matcher, scored = learn.train(features, gold, sizes, [x for x in features.columns if x not in ("s1", "r")], learn.Settings(c.folds, c.boosting_rounds, c.tree_depth, c.learning_rate, c.seed, c.early_stopping, ("global", "two_threshold", "expected_f", "exact")))
    return decide.decide(scored, matcher.rule, matcher.setting(), "pcal").select("s1", "r", "p2a", "p2b", "pcal", "fold")
