"""Normalisation and extraction on pinned examples."""

import pytest
from pyspark.sql import functions as F

from entwine.functions import similarity as sim, text as t, unicode as u
from entwine.operators.canonical import canonicalize, canonicalize_light, normalise


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


def test_unicode():
    assert u.nfkc_lower_text("  Café ") == "café" and u.without_accents("Société") == "Societe"
    assert u.latin_from_indic("प्राइवेट लिमिटेड") == "praivet limited" and u.latin_from_indic("ప్రైవేట్ లిమిటెడ్") == "praivet limited"
    assert u.latin_from_indic("ലിമിറ്റഡ്") == "limirrd" and "alpha" in u.latin_from_indic("अल्फा आईटी")
    assert u.latin_by_name("कमल") == "kamal" and u.latin_by_name("१२") == "12"
    assert u.base_text("L.L.C. Café & Co") == ("llc cafe and co", False)
    assert u.joined_initials(["a", "b", "cd", "e"]) == ["ab", "cd", "e"]


def test_unicode_columns(spark):
    df = spark.createDataFrame([("Ｃafé",), (None,), ("अ",)], "x string")
    got = df.select(u.nfkc_lower("x").alias("a"), u.strip_accents("x").alias("b"), u.transliterate_indic("x").alias("c"), u.base_tokens("x").alias("d")).collect()
    assert [r.a for r in got] == ["café", None, "अ"] and got[2].c == "a" and got[1].d.text == ""


@pytest.mark.parametrize("a,b", [("aggarwal", "agarwal"), ("galli", "gali"), ("shree", "shri"), ("raaj", "raj"), ("bharat", "barat"), ("sidharth", "sidart"), ("vishnu", "visnu"), ("ganesha", "ganesh"), ("shanty", "santi")])
def test_folds_agree(spark, a, b):
    assert one(spark, t.fold, a) == one(spark, t.fold, b)


def test_fold_keeps_single_letters_and_splits(spark):
    assert one(spark, t.fold, "a y, wazir") == "a y vajir"


def test_legal_forms(spark):
    form = lambda x: one(spark, t.legal_form, x)
    assert form("tata motors pvt ltd") == "PRIVATE_LIMITED" and form("google llc") == "LLC" and form("plain name") == ""
    assert form("shkti phud elelpi") == "LLP" and form("praim inphrastrkcr praivet limited") == "PRIVATE_LIMITED"
    rest = lambda x: one(spark, lambda c: t.without_legal_form(c, t.legal_form(c)), x)
    assert rest("tata motors pvt ltd") == "tata motors" and rest("x limited liability company") == "x liability company"
    for pair, want in ((("A", "B"), (0, 1)), (("A", "A"), (1, 0)), (("", "A"), (0, 0))):
        assert tuple(one(spark, lambda a, b: F.array(*t.agreement(a, b)), *pair)) == want


def test_aliases(spark):
    got = one(spark, t.aliases, "reliance retail (smart bazaar)")
    assert got.primary == "reliance retail" and got.alts == ["smart bazaar"]
    got = one(spark, t.aliases, "apex services dba cloud solutions")
    assert got.primary == "apex services" and got.alts == ["cloud solutions"]
    assert one(spark, t.aliases, "una ta las").primary == "una"  # the bare token counts as trading as


def test_address_parts(spark):
    nums = one(spark, t.address_numbers, "plot no. 12/3, sector-5, suite 200")
    assert "12/3" in nums and "5" in nums and one(spark, t.unit_number, "plot no. 12/3, sector-5, suite 200") == "200"
    assert one(spark, t.unit_number, "9th floor") == "or" or one(spark, t.unit_number, "9th floor") == "oor"
    assert one(spark, t.house_number, "1600 main st") == "1600" and one(spark, t.house_number, "12/3 x") == "12" and one(spark, t.house_number, "plot 5") == ""
    for raw, want in (("Mountain View, CA 94043-1351", "94043"), ("Hosur Road 560001", "560001"), ("1234 a, 5678", "5678"), ("none", ""), ("12345 x, 678901", "678901")):
        assert one(spark, t.postal_code, raw) == want
    assert one(spark, t.common_prefix_length, "560001", "560002") == 5
    assert one(spark, t.landmark, "opp. city mall, mg road") == "city mall" and one(spark, t.without_landmark, "opp. city mall, mg road") == "mg road"
    assert one(spark, t.address_tail, "1 a st, san jose, ca 95") == "san jose ca 95"
    assert one(spark, t.expand_streets, "5 main st, lake ave") == "5 main st, lake avenue"  # a comma keeps the short form
    assert one(spark, t.sorted_address, "21st main street 5 b a z") == "215abmain"


def test_abbreviations(spark):
    for a, b in (("pvt", "private"), ("ltd", "limited"), ("corp", "corporation")):
        assert one(spark, t.is_abbreviation, a, b) and one(spark, t.is_abbreviation, b, a)
    assert not one(spark, t.is_abbreviation, "abc", "abc") and not one(spark, t.is_abbreviation, "xyz", "private") and not one(spark, t.is_abbreviation, "pet", "apt")
    split = lambda c: F.split(c, " ")
    assert one(spark, lambda a, b: t.abbreviation_alignment(split(a), split(b)), "tata pvt ltd", "tata private limited") == 1.0
    assert one(spark, t.skeleton, "Corporation") == "crprtn" and one(spark, t.phonetic_key, "yusuf") == "usf" and one(spark, t.phonetic_key, "12ab") == "12ab"


def test_canonical_record(spark):
    df = spark.createDataFrame([("S2-1", "Tata Consultancy Services Ltd (TCS)", "Opp. Forum Mall, Hosur Road, Bangalore, 560029", "India", "S2"), ("S2-2", "", None, "", "S2"), ("S2-3", "Société Générale", "3 rue X", "FR", "S2"), ("S2-4", "टाटा Ltd", "1 A", "IN", "S2")], "entity_id string, business_name string, business_address string, country string, source string")
    a, b, c, d = canonicalize(df).orderBy("entity_id").collect()
    assert a.legal_form == "LIMITED" and "tcs" in a.name_alts and a.postal == "560029" and a.landmark == "forum mall" and a.country_norm == "india" and a.name_core == "tata consultancy services" and a.name_acronym == "tcs"
    assert b.name_missing and b.addr_missing and b.name_core == "" and b.addr_norm == "" and b.name_core_tokens == []
    assert c.country_norm == "france" and c.name_core == "soci t g n rale"  # accents are not stripped first
    assert d.name_core == "tata" and "टाटा Ltd" in d.name_alts
    light = canonicalize_light(df).orderBy("entity_id").first()
    assert light.addr_tail == "road bangalore 560029" and light.postal == "560029"


def test_columnar_normalisation(spark):
    df = spark.createDataFrame([("S1-1", "The L.L.C. Ganesh Pvt Limited", "21st Street, New York, Near Road 5", "US", "S1")], "entity_id string, business_name string, business_address string, country string, source string")
    for flag in (False, True):
        r = normalise(df, ascii_only=flag).first()
        assert r.name_n == "the llc ganesh pvt limited" and r.legal == "llc ltd pvt" and r.name_core == "ganesh"
        assert r.addr_n == "21 st ny nr rd 5" and r.house == "21" and r.nums == "21 5" and r.country_norm == "us"


def test_similarities():
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and sim.jaro_winkler("", "") == 1.0 and sim.jaro_winkler("a", "") == 0.0
    assert sim.damerau("ca", "abc") == 2 and sim.damerau_similarity("", "") == 1.0
    assert sim.ratio("abcd", "abed") == 0.75 and sim.token_sort_ratio("b a", "a b") == 1.0
    assert sim.token_set_ratio("a b c", "a b") == 1.0 and sim.token_set_ratio("", "a") == 0.0 and sim.partial_ratio("abc", "xxabcxx") == 1.0
    assert sim.monge_elkan(["ab"], []) == (0.0, 0.0) and sim.soft_tfidf(["ab"], ["ab"], [2.0], [2.0]) == pytest.approx(1.0)
    for f in (sim.ratio, sim.jaro_winkler, sim.token_set_ratio, sim.damerau_similarity):
        assert f("night", "nacht") == pytest.approx(f("nacht", "night"))


def test_lcs_against_a_table():
    import random

    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert sim.lcs(a, b) == d[-1][-1]


def test_transliteration_by_name():
    """What each class of sign yields."""
    for word, latin in {
        "कमल": "kamal", "भारत": "bharat", "नमस्ते": "namaste", "अमर": "amar", "ऋषि": "rishi", "टाटा": "tata", "ठाकुर": "thakur", "चाय": "chay", "कंपनी": "kanpani",
        "दुःख": "duhkh", "क़लम": "kalam", "क\u200dष": "kash", "৫": "5", "ॐ": "om", "தமிழ்": "tamizh", "തൻ": "tan", "উৎসব": "utsab",
        "कla": "kla", "क ख": "k kh", "latin": "latin", "किताब घर": "kitab ghar",
    }.items():
        assert u.latin_by_name(word) == latin, (word, u.latin_by_name(word))
    assert u.base_text("टाटा मोटर्स लि.") == ("tata motars li", True)


def test_token_strings_of_many_scripts():
    for text, want in {
        "Société Générale S.A.": "societe generale sa", "Straße 5": "strasse 5", "A\u200dB": "ab", "x\u00a0y\tz": "xyz", "a b 1 c d": "ab 1 cd",
        "Ünïcode—dash": "unicode dash", "№ 5": "no 5", "ﬁrm™": "firmtm", "AT&T": "at and t", "": "", "…": "", "é a b": "eab", "日本 株式": "日本 株式",
    }.items():
        assert u.base_text(text) == (want, False), (text, u.base_text(text))
