"""From channels to candidates: country blocks, union with provenance, sibling expansion, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.similarity import measure
from .channels import CHANNELS, EXPANSION_BIT
from .running import stored

EVERYWHERE = "*"


def assign_blocks(s1: DataFrame, pool: DataFrame, by_country: bool = True) -> tuple[DataFrame, DataFrame]:
    """Add `block`: the country inside which a record seeks or is sought.

    S1 records of no known country seek among all. Pool records of no known
    country, or one that no S1 record has, are in every country's block; a country
    for which that leaves none is sought among all. The list of countries has a
    row per country, and pool rows multiply only where their country is unknown.
    """
    if not by_country:
        return s1.withColumn("block", F.lit(EVERYWHERE)), pool.withColumn("block", F.lit(EVERYWHERE))
    known = (F.col("country_norm") != "") & (F.col("country_norm") != "unknown")
    a = s1.withColumn("block", F.when(known, F.col("country_norm")).otherwise(EVERYWHERE))
    blocks = a.select("block").distinct()
    own = blocks.where(F.col("block") != EVERYWHERE)
    tagged = pool.join(own.select(F.col("block").alias("_own")), known & (F.col("country_norm") == F.col("_own")), "left")
    stray = tagged.where("_own is null").drop("_own")
    homed = tagged.where("_own is not null").withColumnRenamed("_own", "block")
    countries = sorted(r[0] for r in own.collect())
    parts = homed
    if countries:
        parts = parts.unionByName(stray.withColumn("block", F.explode(F.array(*map(F.lit, countries)))))
    lonely = set(countries) - {r[0] for r in parts.select("block").distinct().collect()} if countries else set()
    wide = [EVERYWHERE, *sorted(lonely)] if lonely else [EVERYWHERE]
    needed = a.where(F.col("block") == EVERYWHERE).limit(1).count() or lonely
    if needed:
        parts = parts.unionByName(pool.withColumn("block", F.explode(F.array(*map(F.lit, wide)))))
    return a, parts


def run_channels(s1: DataFrame, pool: DataFrame, names: list[str] | None = None, **options: dict) -> DataFrame:
    """(block, channel, s1, r, rank, score) of the channels by name; `options` has arguments by channel."""
    out = None
    for name in names or CHANNELS:
        found = CHANNELS[name][1](s1, pool, **options.get(name, {})).withColumn("channel", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def union(hits: DataFrame) -> DataFrame:
    """One row per pair: mask, n_channels, min_rank, max_score, and maps rank and score by channel."""
    bits = F.create_map(*(F.lit(x) for name, (bit, _) in CHANNELS.items() for x in (name, 1 << bit)), F.lit("expansion"), F.lit(1 << EXPANSION_BIT), F.lit("c7_emb"), F.lit(1 << 6))
    # Dealt once, by S1, whose hits are bounded by the channels; the groups below and the windows of a budget stay in place.
    each = hits.repartition("s1").groupBy("s1", "r", "channel").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    pairs = each.groupBy("s1", "r").agg(
        F.bit_or(F.try_element_at(bits, F.col("channel"))).alias("mask"), F.min("rank").alias("min_rank"), F.max("score").alias("max_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score")))).alias("score"),
    )
    return pairs.withColumn("n_channels", F.bit_count("mask"))


def siblings(pairs: DataFrame, pool: DataFrame, k: int = 3, least: float = 0.9, cap: int = 50) -> DataFrame:
    """(s1, r, channel, rank, score) of records of the other source with the same core and a similar name as one of
    an S1's k best candidates, which are no candidates yet. Of a source's records with one core the first `cap`
    in file order count, as in the other channels, so a common core does not multiply."""
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("s1").orderBy("min_rank", "r"))).where(F.col("_n") <= k).select("s1", F.col("r").alias("via"))
    named = pool.where("name_core <> ''").groupBy("entity_id", "source", "name_core", "name_norm").agg(F.min("row_ord").alias("_ord"))
    a = best.join(named.select(F.col("entity_id").alias("via"), F.col("source").alias("_sa"), "name_core", F.col("name_norm").alias("_na")), "via")
    nth = F.row_number().over(Window.partitionBy("source", "name_core").orderBy("_ord", "entity_id"))
    b = named.withColumn("_nth", nth).where(F.col("_nth") <= cap).select(F.col("entity_id").alias("r"), F.col("source").alias("_sb"), "name_core", F.col("name_norm").alias("_nb"))
    near = a.join(b, "name_core").where("_sa <> _sb").join(pairs.select("s1", "r"), ["s1", "r"], "left_anti")
    scored = near.withColumn("score", measure("token_set_ratio", "_na", "_nb")).where(F.col("score") >= least)
    return scored.groupBy("s1", "r").agg(F.max("score").alias("score")).select("s1", "r", F.lit("expansion").alias("channel"), F.lit(1).alias("rank"), "score")


def prune(pairs: DataFrame, budget: int = 60, keep_from: int = 2) -> DataFrame:
    """Every pair of `keep_from` channels or more, and the best of the others while the budget lasts; adds priority and ord."""
    priority = 100.0 * F.col("n_channels") - F.col("min_rank") + 10.0 * F.col("max_score")
    w = Window.partitionBy("s1")
    multi = (F.col("n_channels") >= keep_from).cast("int")
    ranked = pairs.withColumn("priority", priority).withColumn("_multi", multi)
    order = (F.round("priority", 6).desc(), "r")
    ranked = ranked.withColumns({"_kept": F.sum("_multi").over(w), "_n": F.row_number().over(Window.partitionBy("s1", "_multi").orderBy(*order))})
    left = ranked.where((F.col("_multi") == 1) | (F.col("_n") <= F.greatest(F.lit(budget) - F.col("_kept"), F.lit(0))))
    return left.withColumn("ord", F.row_number().over(w.orderBy(F.desc("_multi"), *order))).drop("_multi", "_kept", "_n")


def candidates(s1: DataFrame, pool: DataFrame, by_country: bool = True, channels: list[str] | None = None, **options: dict) -> DataFrame:
    """The union of the channels over canonical records. Records in blocks, each channel's hits and the union are
    stored, so nothing is found twice and no plan holds more than a channel."""
    a, b = map(stored, assign_blocks(s1, pool, by_country))
    hits = None
    for name in channels or CHANNELS:
        found = stored(run_channels(a, b, [name], **options).drop("block"))
        hits = found if hits is None else hits.unionByName(found)
    return stored(union(hits))


def block_and_prune(s1: DataFrame, pool: DataFrame, budget: int = 100, by_country: bool = True, expansion: bool = True, channels: list[str] | None = None, **options: dict) -> tuple[DataFrame, DataFrame]:
    """(pruned, union) candidates of canonical records."""
    pairs = candidates(s1, pool, by_country, channels, **options)
    if expansion:
        # Siblings are no candidates yet, so theirs are rows of their own.
        pairs = pairs.unionByName(union(siblings(pairs, pool)))
    return prune(pairs, budget), pairs


# The columnar scheme: hashed rare keys.


def rare_keys(records: DataFrame, channel: str) -> DataFrame:
    """(block, id, ord, key) of normalised records: names by token, pair of tokens, phonetic token and whole core;
    addresses by token and pair. Keys are 64-bit hashes, distinct per record; `joint` has both kinds."""
    def pairs(mark: str, toks):
        following = F.slice(toks, 2, 1 << 20)
        return F.when(F.size(toks) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.zip_with(F.slice(toks, 1, F.size(toks) - 1), following, lambda x, y: F.concat(x, F.lit("_"), y)), lambda p: F.concat(F.lit(mark), p)))

    toks = lambda c: F.filter(F.split(F.trim(F.col(c)), r"\s+"), lambda w: w != "")
    mark = lambda m, a: F.transform(a, lambda w: F.concat(F.lit(m), w))
    names = F.concat(
        mark("n", F.filter(toks("name_core"), lambda w: (F.length(w) >= 2) | w.rlike("^[0-9]$"))), pairs("b", toks("name_core")),
        mark("p", F.filter(toks("name_phon"), lambda w: F.length(w) >= 3)), F.when(F.col("name_core") != "", F.array(F.concat(F.lit("w"), "name_core"))).otherwise(F.array().cast("array<string>")),
    )
    places = F.concat(mark("a", F.filter(toks("addr_n"), lambda w: (F.length(w) >= 3) | w.rlike("[0-9]"))), pairs("c", toks("addr_n")))
    keys = {"name": names, "addr": places, "joint": F.concat(names, places)}[channel]
    hashed = F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))
    return records.select("block", F.col("entity_id").alias("id"), F.col("row_ord").alias("ord"), F.posexplode(hashed).alias("at", "key"))


def rare_key_join(queries: DataFrame, postings: DataFrame, n_pool: DataFrame, k: int, df_cap: int, max_keys: int) -> DataFrame:
    """(block, s1, r, score, rank): the k pool records with the largest sum of ln((pool + 1) / df) over shared keys.

    Keys that more than `df_cap` pool records have don't count; of a query's keys
    the `max_keys` rarest do. That bounds a query's pairs by their product, and
    the two caps are what the scores mean, not a way around skew.
    """
    df = postings.groupBy("block", "key").agg(F.count("*").alias("df")).where(F.col("df") <= df_cap)
    w = Window.partitionBy("block", "id").orderBy("df", "at")
    rare = queries.join(df, ["block", "key"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_keys).join(n_pool, "block")
    weighed = rare.select("block", F.col("id").alias("s1"), "key", F.log((F.col("n_pool") + 1) / F.col("df")).alias("w"))
    hits = weighed.join(postings.select("block", "key", F.col("id").alias("r"), F.col("ord").alias("r_ord")), ["block", "key"])
    scored = hits.groupBy("block", "s1", "r").agg(F.min("r_ord").alias("r_ord"), F.sum("w").alias("score"))
    best = Window.partitionBy("block", "s1").orderBy(F.round("score", 9).desc(), "r_ord", "r")
    return scored.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k).drop("r_ord")


def rare_key_candidates(s1: DataFrame, pool: DataFrame, k: dict[str, int] | None = None, df_cap: int = 1000, max_keys: dict[str, int] | None = None) -> DataFrame:
    """Candidates by name, address and both: the three scores and ranks (null where a channel has not the pair), n_channels, cand_count."""
    k, max_keys = k or {"name": 20, "addr": 20, "joint": 20}, max_keys or {"name": 15, "addr": 25, "joint": 40}
    n_pool = pool.groupBy("block").agg(F.count("*").alias("n_pool"))
    hits = None
    for channel, most in k.items():
        found = rare_key_join(rare_keys(s1, channel), rare_keys(pool, channel), n_pool, most, df_cap, max_keys[channel]).withColumn("channel", F.lit(channel))
        hits = found if hits is None else hits.unionByName(found)
    cols = [F.max(F.when(F.col("channel") == c, F.col(x))).cast("double" if x == "score" else "int").alias(f"{c}_{x}") for c in ("name", "addr", "joint") for x in ("score", "rank")]
    pairs = hits.groupBy("block", "s1", "r").agg(*cols, F.count("*").cast("int").alias("n_channels"))
    return pairs.withColumn("cand_count", F.count("*").over(Window.partitionBy("block", "s1")).cast("int"))


def exact_greedy(s1: DataFrame, pool: DataFrame, most: int = 11, least: float = 0.6) -> DataFrame:
    """The baseline without a model: pairs of equal core or address in a country, best first, each pool record once.

    Groups of more than `most` pool records under a key, and entities with more
    pairs than that, are left out. Core pairs need similar addresses, or none on
    the pool's side, and score 1 more than their similarity.
    """
    def side(df: DataFrame, key: str, other: str, names: tuple[str, str, str]) -> DataFrame:
        return df.where(F.col(key) != "").select("country_norm", F.col(key).alias("key"), F.col("entity_id").alias(names[0]), F.col(other).alias(names[1]), F.col("row_ord").alias(names[2]))

    out = None
    for key, other in (("name_core", "addr_norm"), ("addr_norm", "name_core")):
        a, b = side(s1, key, other, ("s1", "oa", "ord_a")), side(pool, key, other, ("r", "ob", "ord_b"))
        few = b.groupBy("country_norm", "key").count().where(F.col("count") <= most).select("country_norm", "key")
        m = a.join(b.join(few, ["country_norm", "key"]), ["country_norm", "key"])
        m = m.withColumn("_n", F.count("*").over(Window.partitionBy("s1"))).where(F.col("_n") <= most).withColumn("sim", measure("token_set_ratio", "oa", "ob"))
        m = m.where((F.col("sim") >= least) | (F.col("ob") == "")).withColumn("score", 1 + F.col("sim")) if key == "name_core" else m.withColumn("score", F.col("sim"))
        m = m.select("s1", "r", "ord_a", "ord_b", "score")
        out = m if out is None else out.unionByName(m)
    pairs = out.groupBy("s1", "r").agg(F.max("score").alias("score"), F.min("ord_a").alias("ord_a"))
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy("r").orderBy(F.round("score", 9).desc(), "ord_a", "s1"))).where("_n = 1").select("s1", "r", "score")


def count_of_keys(s1: DataFrame, pool: DataFrame, k: int = 100, least_tokens: int = 1) -> DataFrame:
    """The light scheme's candidates: how many of seven capped indexes give a pair, the k best."""
    c = F.col
    kinds = {
        "core": (c("name_core"), 50), "fold": (F.when(c("name_fold") != c("name_core"), c("name_fold")).otherwise(""), 50), "clean": (c("name_clean"), 50),
        "house": (F.when((c("postal") != "") & (c("house_no") != ""), F.concat_ws("|", "postal", "house_no")).otherwise(""), 20),
        "addr": (F.when(F.length("addr_clean") >= 10, F.substring("addr_clean", 1, 25)).otherwise(""), 20), "sorted": (F.when(F.length("sorted_addr") >= 6, c("sorted_addr")).otherwise(""), 20),
    }
    own, other = None, None
    for name, (key, cap) in kinds.items():
        a = s1.select("block", F.col("entity_id").alias("s1"), F.lit(name).alias("kind"), key.alias("key")).where("key <> ''")
        b = pool.select("block", F.col("entity_id").alias("r"), F.col("row_ord").alias("r_ord"), F.lit(name).alias("kind"), key.alias("key")).where("key <> ''")
        b = b.withColumn("_n", F.row_number().over(Window.partitionBy("block", "key").orderBy("r_ord", "r"))).where(F.col("_n") <= cap).drop("_n")
        own, other = (a, b) if own is None else (own.unionByName(a), other.unionByName(b))
    toks = F.explode(F.filter(F.array_distinct("name_core_tokens"), lambda w: F.length(w) >= 3)).alias("key")
    b = pool.select("block", F.col("entity_id").alias("r"), F.col("row_ord").alias("r_ord"), toks)
    b = b.withColumn("_n", F.row_number().over(Window.partitionBy("block", "key").orderBy("r_ord", "r"))).where("_n <= 400").drop("_n")
    shared = s1.select("block", F.col("entity_id").alias("s1"), toks).join(b, ["block", "key"]).groupBy("block", "s1", "r").agg(F.min("r_ord").alias("r_ord"), F.count("*").alias("n")).where(F.col("n") >= least_tokens)
    hits = own.join(other, ["block", "kind", "key"]).select("block", "s1", "r", "r_ord", "kind").unionByName(shared.select("block", "s1", "r", "r_ord", F.lit("token").alias("kind")))
    scored = hits.groupBy("block", "s1", "r").agg(F.min("r_ord").alias("r_ord"), F.count_distinct("kind").alias("score"))
    best = Window.partitionBy("block", "s1").orderBy(F.desc("score"), "r_ord", "r")
    return scored.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k).select("block", "s1", "r", "rank", "score")


def inverted_index(s1: DataFrame, pool: DataFrame, most: int = 60, overlap: int = 30, token_cap: int = 500) -> DataFrame:
    """(s1, r, ord): the second baseline's candidates, the first `most` of an entity in the order of its indexes.

    Indexes by core, fold and clean name, then names that share two tokens or more
    (the `overlap` best not found so far), then by address, postal code with house
    number, and sorted address. An index lists the first records in file order, up to its cap.
    """
    c = F.col
    sorted_key, address = F.when(F.length("sorted_addr") >= 6, c("sorted_addr")).otherwise(""), F.when(F.length("addr_clean") >= 10, F.substring("addr_clean", 1, 25)).otherwise("")
    house = F.when((c("postal") != "") & (c("house_no") != ""), F.concat_ws("|", "postal", "house_no")).otherwise("")
    indexes = {0: (c("name_core"), 50), 1: (c("name_fold"), 50), 2: (c("name_clean"), 50), 4: (address, 20), 5: (house, 15), 6: (sorted_key, 20)}
    one_of = lambda kinds: F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), key.alias("key"), F.lit(cap).alias("cap")) for k, (key, cap) in kinds.items()))).alias("i")
    own = s1.select("block", F.col("entity_id").alias("s1"), one_of(indexes)).select("block", "s1", "i.kind", "i.key").where("key <> ''")
    listed = pool.select("block", F.col("entity_id").alias("r"), F.col("row_ord").alias("r_ord"), "name_core", one_of(indexes)).select("block", "r", "r_ord", "name_core", "i.*")
    listed = listed.where((F.col("key") != "") & ((F.col("kind") != 1) | (F.col("key") != F.col("name_core"))))
    listed = listed.withColumn("_n", F.row_number().over(Window.partitionBy("block", "kind", "key").orderBy("r_ord", "r"))).where("_n <= cap").select("block", "kind", "key", "r", "r_ord")
    hits = own.join(listed, ["block", "kind", "key"]).select("s1", "r", "kind", F.lit(0).cast("long").alias("less"), "r_ord")
    toks = F.explode(F.filter(F.array_distinct("name_core_tokens"), lambda w: F.length(w) >= 2)).alias("key")
    postings = pool.select("block", F.col("entity_id").alias("r"), F.col("row_ord").alias("r_ord"), toks)
    postings = postings.withColumn("_n", F.row_number().over(Window.partitionBy("block", "key").orderBy("r_ord", "r"))).where(F.col("_n") <= token_cap).drop("_n")
    shared = s1.where(F.size("name_core_tokens") >= 2).select("block", F.col("entity_id").alias("s1"), toks).join(postings, ["block", "key"])
    shared = shared.groupBy("s1", "r").agg(F.min("r_ord").alias("r_ord"), F.count("*").alias("n")).where("n >= 2").join(hits.where("kind <= 2").select("s1", "r").distinct(), ["s1", "r"], "left_anti")
    best = Window.partitionBy("s1").orderBy(F.desc("n"), "r_ord", "r")
    named = shared.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= overlap).select("s1", "r", F.lit(3).alias("kind"), (-F.col("n")).alias("less"), "r_ord")
    first = hits.unionByName(named).groupBy("s1", "r").agg(F.min(F.struct("kind", "less", "r_ord")).alias("at"))
    place = F.row_number().over(Window.partitionBy("s1").orderBy("at", "r")) - 1
    return first.select("s1", "r", place.alias("ord")).where(F.col("ord") < most)
