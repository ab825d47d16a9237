"""From raw records to canonical ones: the normalised forms that all later operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t, unicode as u
from .running import materialise

STRING_LISTS = "name_alts name_tokens name_core_tokens addr_tokens addr_nums".split()


def canonicalize(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Add the canonical name, address and country columns to (entity_id, business_name, business_address, country, source).

    All steps but Unicode ones are Spark expressions. `ascii_only` leaves those
    out for input that is known to have none but ASCII characters. The result is
    materialised: everything after it reads it many times.
    """
    raw = lambda c: F.coalesce(F.col(c), F.lit(""))
    if ascii_only:
        low = lambda c: F.trim(F.lower(raw(c)))
        latin = raw
    else:
        latin = lambda c: u.transliterate_indic(raw(c))
        low = lambda c: u.nfkc_lower(latin(c))
    df = records.withColumns({"_name": low("business_name"), "_addr": low("business_address"), "_latin": latin("business_address"), "_country": F.trim(F.lower(raw("country"))) if ascii_only else u.nfkc_lower(raw("country"))})
    df = _names(df, ascii_only)
    df = _addresses(df, ascii_only)
    return materialise(df.withColumn("country_norm", t.country(F.col("_country"))).drop("_name", "_addr", "_latin", "_country"))


def _names(df: DataFrame, ascii_only: bool) -> DataFrame:
    spelled = F.replace(F.replace(F.replace(F.col("_name"), F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    df = df.withColumn("_n", spelled).withColumn("_a", t.aliases(F.col("_n"))).withColumn("_short", t.without_domain(F.col("_a.primary")))
    changed = (F.col("_short") != "") & (F.col("_short") != F.col("_a.primary"))
    df = df.withColumns({"_primary": F.when(changed, F.col("_short")).otherwise(F.col("_a.primary")), "_alts": F.concat(F.col("_a.alts"), F.when(changed, F.array("_short")).otherwise(F.array().cast("array<string>")))})
    df = df.withColumn("legal_form", t.legal_form(F.col("_primary"))).withColumn("_core", t.without_legal_form(F.col("_primary"), F.col("legal_form")))
    df = df.withColumns({"_all": t.tokens(F.col("_n")), "_raw": t.tokens(F.col("_core"))})
    df = df.withColumns({"name_tokens": t.collapse_repeats(F.col("_all")), "_raw": t.collapse_repeats(F.col("_raw"))})
    meaning = F.filter("_raw", lambda w: ~w.isin(*t.NAME_STOP_WORDS))
    df = df.withColumn("_meaning", meaning).withColumn("name_core_tokens", F.when(F.size("_meaning") > 0, F.col("_meaning")).otherwise(F.col("_raw")))
    df = df.withColumns({"name_norm": F.array_join("name_tokens", " "), "name_core": F.array_join("name_core_tokens", " "), "name_clean": F.array_join("name_core_tokens", ""), "name_acronym": t.acronym(F.col("name_core_tokens")), "_whole": F.array_join("_all", " ")})
    alts = F.filter(F.transform("_alts", lambda a: F.array_join(t.tokens(a), " ")), lambda a: (a != "") & (a != F.col("_whole")))
    if not ascii_only:
        original = F.col("business_name")
        alts = F.when(original.rlike("[\\u0900-\\u0D7F]") & ~F.array_contains(alts, original), F.concat(alts, F.array(original))).otherwise(alts)
    df = df.withColumns({"name_alts": alts, "name_fold": F.array_join(F.transform("name_core_tokens", t.fold_token), " "), "name_missing": F.col("_name") == ""})
    return df.drop("_n", "_a", "_short", "_primary", "_alts", "_core", "_all", "_raw", "_meaning", "_whole")


def _addresses(df: DataFrame, ascii_only: bool) -> DataFrame:
    a = F.col("_addr")
    df = df.withColumns({"addr_tail": t.address_tail(a), "landmark": t.landmark(a), "_plain": t.without_landmark(a), "postal": t.postal_code(F.col("_latin"))})
    p = F.col("_plain")
    df = df.withColumns({"addr_nums": t.address_numbers(p), "house_no": t.house_number(p), "unit": t.unit_number(p), "addr_tokens": t.tokens(t.expand_streets(p), "a-z0-9/")})
    df = df.withColumn("addr_norm", F.array_join("addr_tokens", " "))
    return df.withColumns({
        "addr_clean": F.regexp_replace("addr_norm", "[^a-z0-9]", ""),
        "sorted_addr": t.sorted_address(F.col("addr_norm")),
        "addr_fold": t.fold(F.col("addr_norm"), ascii_only=True),
        "addr_missing": a == "",
        "postal_missing": F.col("postal") == "",
        "house_no_missing": F.col("house_no") == "",
    }).drop("_plain")


def canonicalize_light(records: DataFrame) -> DataFrame:
    """The light scheme: no aliases, landmarks, stop words or accents; the tail is the last three tokens."""
    raw = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = records.withColumns({"_name": F.trim(F.lower(u.transliterate_indic(raw("business_name")))), "addr_norm": F.trim(u.transliterate_indic(raw("business_address"))), "country_norm": F.trim(F.lower(raw("country")))})
    df = df.withColumn("legal_form", t.legal_form(F.col("_name"))).withColumn("_core", t.without_legal_form(F.col("_name"), F.col("legal_form")))
    df = df.withColumns({"name_norm": F.array_join(t.tokens(F.col("_name")), " "), "name_core_tokens": t.tokens(F.col("_core")), "addr_tokens": t.tokens(F.lower("addr_norm"))})
    return materialise(df.withColumns({
        # What the pair features ask for beyond this scheme: no aliases and landmarks.
        "name_alts": F.array().cast("array<string>"), "landmark": F.lit(""), "addr_missing": F.col("addr_norm") == "", "addr_fold": F.array_join(F.transform("addr_tokens", t.fold_token), " "),
        "name_core": F.array_join("name_core_tokens", " "), "name_clean": F.regexp_replace(F.lower("_name"), r"[^\p{L}\p{N}]", ""),
        "name_fold": F.array_join(F.transform("name_core_tokens", t.fold_token), " "), "name_acronym": t.acronym(F.col("name_core_tokens")),
        "postal": t.postal_code(F.col("addr_norm")), "house_no": t.house_number(F.lower("addr_norm")), "unit": t.unit_number(F.lower("addr_norm")),
        "addr_nums": t.address_numbers(F.lower("addr_norm")), "addr_clean": F.regexp_replace(F.lower("addr_norm"), r"[^\p{L}\p{N}]", ""),
        "sorted_addr": t.sorted_address(F.lower("addr_norm")), "addr_tail": F.array_join(F.slice("addr_tokens", F.greatest(F.size("addr_tokens") - 2, F.lit(1)), F.lit(3)), " "),
    }).drop("_name", "_core"))


# The columnar scheme.

# Legal words and what they stand for.
LEGAL_WORDS = {
    "limited": "ltd", "ltd": "ltd", "limitet": "ltd", "limted": "ltd", "limitad": "ltd", "ltda": "ltd",
    "private": "pvt", "pvt": "pvt", "pvtltd": "pvt", "praivet": "pvt", "prayvet": "pvt", "privet": "pvt",
    "llc": "llc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "lp": "lp", "llp": "llp", "pllc": "pllc", "pc": "pc", "plc": "plc", "sarl": "sarl", "sarlu": "sarl", "sas": "sas", "sasu": "sas",
    "sa": "sa", "eurl": "eurl", "snc": "snc", "sci": "sci", "selarl": "selarl", "eirl": "eirl", "scop": "scop", "scm": "scm",
    "gie": "gie", "cie": "co", "compagnie": "co", "gmbh": "gmbh", "ag": "ag", "bv": "bv", "pty": "pty", "opc": "opc", "elaelapi": "llp",
}
# Words that a core leaves out in this scheme.
CORE_STOP_WORDS = "the and of a an ms et le la les de du des l d au aux en".split()
# States of the United States by their postal codes.
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee",
    "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin",
    "wy": "wyoming", "dc": "district of columbia",
}
# States and renamed cities of India.
INDIAN_PLACES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj",
    "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp",
    "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od",
    "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "tg", "tripura": "tr", "uttar pradesh": "up",
    "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la",
    "chandigarh": "ch", "puducherry": "py", "pondicherry": "py", "bombay": "mumbai", "bangalore": "bengaluru", "madras": "chennai",
    "calcutta": "kolkata", "maharashtr": "mh", "telangan": "tg", "karnatak": "ka", "keralam": "kl", "gurgaon": "gurugram",
    "poona": "pune", "belgaum": "belagavi",
}
# Street words and their short forms in this scheme.
SHORT_STREETS = {
    "street": "st", "road": "rd", "drive": "dr", "avenue": "ave", "av": "ave", "lane": "ln", "court": "ct", "boulevard": "blvd",
    "bd": "blvd", "place": "pl", "circle": "cir", "highway": "hwy", "parkway": "pkwy", "terrace": "ter", "square": "sq", "suite": "ste",
    "apartment": "apt", "building": "bldg", "floor": "fl", "flr": "fl", "number": "no", "near": "nr", "opposite": "opp", "north": "n",
    "south": "s", "east": "e", "west": "w", "ts": "tg", "r": "rue", "bld": "blvd", "chemin": "chem", "che": "chem", "impasse": "imp",
    "route": "rte", "allees": "allee", "all": "allee", "faubourg": "fbg", "residence": "res", "quartier": "qu", "saint": "st",
    "sainte": "ste", "bis": "b",
}


def contract_places(x: Column) -> Column:
    """State and city names of a token string to their short forms, the longest first."""
    places = {name: code for code, name in US_STATES.items()} | INDIAN_PLACES
    longest = sorted(places, key=lambda p: (-len(p), p))
    marked = F.regexp_replace(x, r"\b(" + "|".join(longest) + r")\b", "\x01$1\x01")
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda s: t.lookup(s, places)), "")


def normalise(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """The columnar scheme: name_n, name_core, name_phon, legal, name_tr, addr_n, house, nums, addr_tr, country_norm."""
    def based(c: str) -> Column:
        raw = F.coalesce(F.col(c), F.lit(""))
        if ascii_only:
            plain = t.squeeze(F.regexp_replace(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
            run = F.regexp_replace(plain, r"(?<![^ ])([a-z]) (?=[a-z](?: |$))", "$1")
            return F.struct(run.alias("text"), F.lit(False).alias("indic"))
        return u.base_tokens(raw)

    df = records.withColumns({"_n": based("business_name"), "_a": based("business_address"), "_c": based("country")})
    toks = t.words(F.col("_n.text"))
    df = df.withColumn("_t", toks).withColumns({
        "_plain": F.filter("_t", lambda w: ~w.isin(*CORE_STOP_WORDS)),
        "legal": F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("_t", lambda w: w.isin(*LEGAL_WORDS)), lambda w: t.lookup(w, LEGAL_WORDS)))), " "),
    })
    df = df.withColumn("_core", F.filter("_plain", lambda w: ~w.isin(*LEGAL_WORDS)))
    df = df.withColumn("_core", F.when(F.size("_core") > 0, F.col("_core")).when(F.size("_plain") > 0, F.col("_plain")).otherwise(F.col("_t")))
    ordinals = F.transform(t.words(F.col("_a.text")), lambda w: F.regexp_replace(w, r"^(\d+)(st|nd|rd|th)$", "$1"))
    df = df.withColumn("_at", F.transform(t.words(contract_places(F.array_join(ordinals, " "))), lambda w: t.lookup(w, SHORT_STREETS)))
    return materialise(df.select(
        *records.columns, F.col("_n.text").alias("name_n"), F.array_join("_core", " ").alias("name_core"), F.array_join(F.transform("_core", t.phonetic_key), " ").alias("name_phon"), "legal", F.col("_n.indic").alias("name_tr"),
        F.array_join("_at", " ").alias("addr_n"), F.coalesce(F.get(F.filter("_at", lambda w: w.rlike("^[0-9]")), F.lit(0)), F.lit("")).alias("house"),
        F.array_join(F.array_distinct(F.filter("_at", lambda w: w.rlike("[0-9]"))), " ").alias("nums"), F.col("_a.indic").alias("addr_tr"), F.col("_c.text").alias("country_norm"),
    ))
