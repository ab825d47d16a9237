"""Text normalisation and extraction as column expressions: no Python in the hot path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .unicode import strip_accents

#: What is trimmed from the ends of names and addresses.
EDGES = " ,.-/"

# Words that a name's core leaves out.
NAME_STOP_WORDS = "the and of for in at by to a an co company".split()

# Legal forms by pattern; the first that matches wins.
LEGAL_FORMS = (
    (r"\b(pvt\.?\s*ltd\.?|private\s+limited|p\.?\s*ltd\.?|praivet\s+limited|praivrr\s+limirrd|pra\.?\s*li\.?)\b", "PRIVATE_LIMITED"),
    (r"\b(ltd\.?|limited|public\s+limited|limirrd)\b", "LIMITED"),
    (r"\b(corp\.?|corporation)\b", "CORPORATION"),
    (r"\b(inc\.?|incorporated)\b", "INCORPORATED"),
    (r"\b(l\.?l\.?c\.?|llc|limited\s+liability\s+company)\b", "LLC"),
    (r"\b(l\.?l\.?p\.?|llp|limited\s+liability\s+partnership|elelpi)\b", "LLP"),
    (r"\b(proprietorship|prop\.?)\b", "PROPRIETORSHIP"),
    (r"\b(partnership|partn\.?)\b", "PARTNERSHIP"),
    (r"\b(s\.?a\.?r\.?l\.?|sarl)\b", "SARL"),
    (r"\b(s\.?a\.?s\.?|sas)\b", "SAS"),
    (r"\b(s\.?a\.?|sa)\b", "SA"),
    (r"\b(gmbh)\b", "GMBH"),
    (r"\b(co\.?|company)\b", "COMPANY"),
    (r"\b(enterprises?|ents?\.?)\b", "ENTERPRISE"),
    (r"\b(holdings?)\b", "HOLDINGS"),
)

# What introduces another name.
ALIAS_MARKS = (
    r"\b(?:d/?b/?a|doing\s+business\s+as)\b\s*(.+)",
    r"\b(?:t/?a|trading\s+as)\b\s*(.+)",
    r"\b(?:a/?k/?a|also\s+known\s+as)\b\s*(.+)",
)

# Spellings of countries.
COUNTRY_ALIASES = {
    "usa": "us", "united states": "us", "united states of america": "us", "u.s.a.": "us", "u.s.": "us",
    "in": "india", "ind": "india", "fr": "france", "fra": "france",
}

# Street words by their abbreviations.
STREET_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "pl": "place", "sq": "square", "hwy": "highway", "pkwy": "parkway", "str": "street", "marg": "road", "gali": "street",
    "galli": "street", "nagar": "nagar", "ste": "suite", "apt": "apartment", "flr": "floor",
}

# Words that the sorted address key leaves out.
SORTED_ADDRESS_STOP_WORDS = "st street ave avenue rd road blvd dr drive ln lane ct court pl place terrace null township apt suite ste flr floor".split()

# Patterns of address parts and of web names.
LANDMARK = r"\b(?:near|opp\.?|opposite|behind|beside|next\s+to|adjacent\s+to)\s+([^,;]+)"
HOUSE = r"^\s*(?:plot\s+no\.?\s*)?([0-9]+[a-z]?|[0-9]+/[0-9]+)\b"
UNIT = r"\b(?:suite|ste|shop|unit|flat|fl|floor|apt|apartment|room|rm)\s*([0-9a-z\-/]+)\b"
NUMBER = r"\b([0-9]+(?:[/\-][0-9a-z]+)?|[0-9]+[a-z]?)\b"
DOMAIN = r"\.(?:com|org|net|co\.in|in|co|io|biz|info|gov|edu|fr|us)(?=[/\s]|$)"

# The steps of folding and of phonetic keys, in order.
VOWEL_FOLDS = (("aa+", "a"), ("ee+", "i"), ("ii+", "i"), ("oo+", "u"), ("ou+", "u"))
ASPIRATE_FOLDS = (("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("ph", "f"), ("jh", "j"), ("ch", "c"))
CONSONANT_FOLDS = (("sh", "s"), ("w", "v"), ("z", "j"), ("ck", "k"), ("q", "k"))
PHONETIC_STEPS = (
    ("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("sh", "s"),
    ("ch", "c"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("w", "v"), ("z", "j"), ("c", "k"), ("y", "i"),
)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def trim_edges(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "), F.lit(EDGES))


def tokens(x: Column, kept: str = "a-z0-9") -> Column:
    """Runs of the kept characters."""
    return F.filter(F.split(F.regexp_replace(x, f"[^{kept}]+", " "), " "), lambda t: t != "")


def words(x: Column) -> Column:
    """Runs of what is not white space."""
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def collapse_repeats(toks: Column) -> Column:
    """Consecutive equal tokens once. `toks` should be a plain column."""
    return F.filter(toks, lambda t, i: (i == 0) | (t != F.get(toks, i - 1)))


def lookup(x: Column, known: dict[str, str]) -> Column:
    """The value for a key, the key itself if there is none."""
    table = F.create_map(*(F.lit(y) for pair in known.items() for y in pair))
    return F.coalesce(F.try_element_at(table, x), x)


def fold_token(t: Column) -> Column:
    """One spelling for the common transliterations of a token; single letters stay."""
    x = reduce(lambda a, r: F.regexp_replace(a, *r), VOWEL_FOLDS, t)
    x = F.regexp_replace(x, r"([a-z])\1+", "$1")
    x = reduce(lambda a, r: F.replace(a, F.lit(r[0]), F.lit(r[1])), (*ASPIRATE_FOLDS, *CONSONANT_FOLDS), x)
    x = F.regexp_replace(x, "^(.{2,}[^aeiou])a$", "$1")
    x = F.regexp_replace(x, "y$", "i")
    return F.when(F.length(t) <= 1, t).otherwise(F.regexp_replace(x, r"([a-z])\1+", "$1"))


def fold(x: Column, ascii_only: bool = False) -> Column:
    """The folded tokens of a lower-case text; accents go first unless the text has none."""
    clean = x if ascii_only else F.lower(strip_accents(x))
    return F.array_join(F.transform(tokens(clean), fold_token), " ")


def phonetic_key(t: Column) -> Column:
    """A consonant skeleton of an alphabetic token; others stay."""
    x = F.when(t.startswith("yu"), F.substring(t, 2, 1 << 20)).otherwise(t)
    x = reduce(lambda a, r: F.replace(a, F.lit(r[0]), F.lit(r[1])), PHONETIC_STEPS, x)
    x = F.concat(F.substring(x, 1, 1), F.regexp_replace(F.substring(x, 2, 1 << 20), "[aeiou]", ""))
    return F.when(t.rlike(r"^\p{L}+$"), F.regexp_replace(x, r"(.)\1+", "$1")).otherwise(t)


def acronym(toks: Column) -> Column:
    """Initials, of two tokens or more."""
    return F.when(F.size(toks) < 2, F.lit("")).otherwise(F.array_join(F.transform(toks, lambda t: F.substring(t, 1, 1)), ""))


def legal_form(x: Column) -> Column:
    """The canonical form of the first pattern that matches, or empty."""
    out = F.lit("")
    for pattern, name in reversed(LEGAL_FORMS):
        out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def without_legal_form(x: Column, form: Column) -> Column:
    """The text without any occurrence of its form's pattern."""
    out = x
    for pattern, name in LEGAL_FORMS:
        out = F.when(form == name, F.regexp_replace(x, pattern, " ")).otherwise(out)
    return trim_edges(out)


def agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """(1 if both are given and equal, 1 if both are given and differ)."""
    both = (a != "") & (b != "")
    return (both & (a == b)).cast("int"), (both & (a != b)).cast("int")


def aliases(x: Column) -> Column:
    """struct(primary, alts) of a lower-case name: names in brackets and after dba, t/a or aka are alternatives."""
    inner = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda a: F.trim(a)), lambda a: F.length(a) >= 2)
    primary, alts = F.regexp_replace(x, r"\([^)]*\)", " "), inner
    for mark in ALIAS_MARKS:
        hit = primary.rlike(mark)
        found = F.trim(F.regexp_extract(primary, mark, 1))
        alts = F.concat(alts, F.when(hit & (F.length(found) >= 2), F.array(found)).otherwise(F.array().cast("array<string>")))
        primary = F.when(hit, F.trim(F.regexp_extract(primary, r"(?s)^(.*?)" + mark, 1))).otherwise(primary)
    primary = trim_edges(primary)
    return F.struct(primary.alias("primary"), F.filter(F.transform(alts, trim_edges), lambda a: (a != "") & (a != primary)).alias("alts"))


def without_domain(x: Column) -> Column:
    """A name without http://, www. and domain endings."""
    x = F.regexp_replace(x, r"https?://", "")
    x = F.regexp_replace(x, r"\bwww\.", "")
    return F.trim(F.regexp_replace(x, DOMAIN, ""))


def landmark(x: Column) -> Column:
    """What follows near, opposite, behind and the like, up to a comma."""
    return F.trim(F.regexp_extract(x, LANDMARK, 1))


def without_landmark(x: Column) -> Column:
    """The address without its first landmark phrase."""
    at = F.regexp_instr(x, F.lit(LANDMARK))
    rest = F.concat(x.substr(F.lit(1), at - 1), F.lit(" "), x.substr(at + F.length(F.regexp_extract(x, LANDMARK, 0)), F.length(x)))
    return F.when(at > 0, trim_edges(rest)).otherwise(x)


def address_numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(NUMBER), F.lit(1))


def house_number(x: Column) -> Column:
    return F.regexp_extract(x, HOUSE, 1)


def unit_number(x: Column) -> Column:
    return F.regexp_extract(x, UNIT, 1)


def postal_code(x: Column) -> Column:
    """ZIP+4 without its end, else the last number of five or six digits, else the last of four."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(x, F.lit(p), F.lit(0)), F.lit(-1))
    return F.coalesce(F.nullif(F.regexp_extract(x, r"\b(\d{5})-\d{4}\b", 1), F.lit("")), last(r"\b\d{5,6}\b"), last(r"\b\d{4}\b"), F.lit(""))


def common_prefix_length(a: Column, b: Column, most: int = 6) -> Column:
    """Length of the common prefix, of short texts."""
    out = F.lit(0)
    for n in range(1, most + 1):
        out = F.when((F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)), F.lit(n)).otherwise(out)
    return out


def expand_streets(x: Column) -> Column:
    return F.array_join(F.transform(words(x), lambda t: lookup(t, STREET_WORDS)), " ")


def sorted_address(x: Column) -> Column:
    """The first five tokens in order, without street words, joined; ordinals count as numbers."""
    plain = F.regexp_replace(x, r"(\d+)(?:st|nd|rd|th)\b", "$1")
    kept = F.filter(tokens(plain), lambda t: ~t.isin(*SORTED_ADDRESS_STOP_WORDS))
    return F.array_join(F.slice(F.array_sort(kept), 1, 5), "")


def address_tail(x: Column) -> Column:
    """The last two segments between commas."""
    parts = F.filter(F.transform(F.split(x, ","), lambda s: F.trim(s)), lambda s: s != "")
    n = F.size(parts)
    tail = F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), " "))
    return F.trim(F.regexp_replace(tail, "[^a-z0-9]+", " "))


def country(x: Column) -> Column:
    return lookup(x, COUNTRY_ALIASES)


def skeleton(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^b-df-hj-np-tv-z]", "")


def is_abbreviation(a: Column, b: Column) -> Column:
    """Whether the shorter is a beginning, a run of the other's consonants, or up to four letters of it in order from the first."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    two = F.length(short) >= 2
    starts = two & long.startswith(short)
    inside = two & F.contains(skeleton(long), short)
    first = (F.substring(short, 1, 1) == F.substring(long, 1, 1)) & (F.length(short) <= 4)
    # Letters in order: fold over the letters of the shorter one, keeping the place reached (0: failed).
    place = F.aggregate(F.split(short, ""), F.lit(1), lambda at, c: F.when((c == "") | (at == 0), at).otherwise(_next_place(long, c, at)))
    return (a != "") & (b != "") & (a != b) & (starts | inside | (first & (place > 0)))


def _next_place(text: Column, letter: Column, at: Column) -> Column:
    """The place after the next occurrence of the letter from place `at` on, or 0."""
    found = F.call_function("locate", letter, text, at)
    return F.when(found > 0, found + 1).otherwise(F.lit(0))


def abbreviation_alignment(a: Column, b: Column) -> Column:
    """The share of the shorter side's unshared tokens that abbreviate an unshared one of the other side."""
    left = F.filter(F.array_except(a, b), lambda t: F.length(t) >= 2)
    right = F.filter(F.array_except(b, a), lambda t: F.length(t) >= 2)
    short = F.when(F.size(left) <= F.size(right), left).otherwise(right)
    long = F.when(F.size(left) <= F.size(right), right).otherwise(left)
    hits = F.size(F.filter(short, lambda s: F.exists(long, lambda t: is_abbreviation(s, t))))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(hits / F.size(short))
