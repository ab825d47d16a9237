"""Blocking, decisions, metrics and checks against brute force and pinned values."""

import itertools
import random
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from entwine.operators import candidates as cand, channels as ch, checks, decide, features as feat, metrics
from entwine.operators.canonical import canonicalize
from entwine.operators.running import running_sums
from entwine.sources import synthetic

KIND = "entity_id string, business_name string, business_address string, country string, source string, row_ord long"


@pytest.fixture(scope="module")
def small(spark):
    s1 = [("S1-1", "Infosys Ltd", "44 Hosur Road, Bangalore, 560100", "India"), ("S1-2", "Starbucks Coffee", "1 Pike St, Seattle, WA 98101", "US"), ("S1-3", "Acme Widgets", "9 Elm St, Boston, MA 02110", "US")]
    pool = [("S2-10", "Infosys Limited", "44 Hosur Rd, Bangalore, 560100", "India"), ("S2-20", "Starbucks", "1 Pike Street, Seattle, 98101", "US"), ("S3-30", "Zenith Foods", "7 Oak Ave, Austin, TX 73301", "US"), ("S3-40", "Orphan", "x", "Peru")]
    rows = [(*r, r[0][:2], i) for i, r in enumerate(s1 + pool)]
    rec = canonicalize(spark.createDataFrame(rows, KIND))
    return rec.where("source = 'S1'"), rec.where("source <> 'S1'")


@pytest.fixture(scope="module")
def made(spark):
    s1, pool, gold = synthetic.registry(spark, 60, seed=7)
    return canonicalize(s1), canonicalize(pool), gold


def test_blocking_finds_the_pairs(spark, small):
    s1, pool = small
    pruned, union = cand.block_and_prune(s1, pool, budget=10)
    pairs = {(r.s1, r.r) for r in pruned.collect()}
    assert ("S1-1", "S2-10") in pairs and ("S1-2", "S2-20") in pairs
    gold = spark.createDataFrame([("S1-1", "S2-10"), ("S1-2", "S2-20")], "s1 string, r string")
    q = metrics.blocking_quality(s1.select(F.col("entity_id").alias("s1")), pruned, gold, 3, 4).first()
    assert q.pair_completeness == q.entity_recall == q.ceiling_f05 == 1.0
    assert union.where("mask & 128 > 0").count() >= 0


def test_country_blocks(spark, small):
    s1, pool = small
    stateless = spark.createDataFrame([("S1-9", "Nowhere", "", "", "S1", 9)], KIND)
    a, b = cand.assign_blocks(s1.unionByName(canonicalize(stateless)), pool)
    blocks = {(r.entity_id, r.block) for r in b.select("entity_id", "block").collect()}
    assert {(e, k) for e, k in blocks if e == "S3-40"} == {("S3-40", "india"), ("S3-40", "us"), ("S3-40", "*")}
    assert ("S2-10", "us") not in blocks and ("S2-10", "*") in blocks
    assert {r.block for r in a.collect()} == {"india", "us", "*"}


def blocked(made):
    s1, pool, _ = made
    return cand.assign_blocks(s1, pool, by_country=False)


def test_rare_tokens_against_brute_force(made):
    a, b = blocked(made)
    got = {(r.s1, r.r): round(r.score, 6) for r in ch.rare_tokens(a, b, max_df=20, k=10**6).collect()}
    left, right = ([(r.entity_id, {w for w in r.name_core_tokens if len(w) >= 2 or w.isdigit()}) for r in x.collect()] for x in (a, b))
    df = {}
    for _, ws in right:
        for w in ws:
            df[w] = df.get(w, 0) + 1
    n = len(left) + len(right)
    want = {}
    for s, ws in left:
        for r, vs in right:
            shared = [w for w in ws & vs if df[w] <= 20]
            if shared:
                want[(s, r)] = round(sum(log((n + 1) / (df[w] + 1)) + 1 for w in shared), 6)
    assert got == want


def test_sorted_neighbourhood_against_brute_force(made):
    a, b = blocked(made)
    window = 4
    got = {(r.s1, r.r): round(r.score, 6) for r in ch.sorted_neighbourhood(a, b, window).collect()}
    rows = [(r.entity_id, r.name_core, r.country_norm, r.row_ord, 0) for r in a.collect()] + [(r.entity_id, r.name_core, r.country_norm, r.row_ord, 1) for r in b.collect()]
    want = {}
    for key in (lambda x: x[1], lambda x: x[1][::-1]):
        order = sorted(rows, key=lambda x: (key(x), x[4], x[3], x[0]))
        found = {}
        for i, x in enumerate(order):
            if x[4] == 0:
                for j in range(max(0, i - window), min(len(order), i + window + 1)):
                    y = order[j]
                    if y[4] == 1 and not (x[2] and y[2] and x[2] != y[2]):
                        found[(x[0], y[0])] = round(1 / (abs(i - j) + 1), 6)
        want = found | want
    assert got == want


def test_tfidf_against_brute_force(made):
    a, b = blocked(made)
    got = {(r.s1, r.r): r.score for r in ch.tfidf(a, b, k=10**6, least=0.05).collect()}
    for source in ("S2", "S3"):
        left, right = a.collect(), [r for r in b.collect() if r.source == source]

        def grams(x):
            out = {}
            for w in x.split():
                p = f" {w} "
                for n in (2, 3, 4):
                    parts = [p[i : i + n] for i in range(max(1, len(p) - n + 1))]
                    for g in parts:
                        out[g] = out.get(g, 0) + 1
                    if len(p) <= n:
                        break
            return out

        docs = [grams(r.name_norm or "empty") for r in left + right]
        df = {}
        for d in docs:
            for g in d:
                df[g] = df.get(g, 0) + 1
        vecs = []
        for d in docs:
            v = {g: (1 + log(c)) * (log((1 + len(docs)) / (1 + df[g])) + 1) for g, c in d.items()}
            norm = sum(x * x for x in v.values()) ** 0.5
            vecs.append({g: x / norm for g, x in v.items()})
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                s = sum(w * vecs[len(left) + j].get(g, 0) for g, w in vecs[i].items())
                assert (s > 0.05) == ((x.entity_id, y.entity_id) in got) or abs(s - 0.05) < 1e-9
                if s > 0.05:
                    assert got[(x.entity_id, y.entity_id)] == pytest.approx(s)


def test_rare_key_join_against_brute_force(spark):
    rng = random.Random(3)
    keys = lambda n: {f"r{i}": sorted({rng.randrange(30) for _ in range(6)}) for i in range(n)}
    q, p = keys(15), keys(40)
    frame = lambda d: spark.createDataFrame([("b", i, n, at, k) for n, (i, ks) in enumerate(d.items()) for at, k in enumerate(ks)], "block string, id string, ord long, at int, key long")
    got = {(r.s1, r.r): (round(r.score, 6), r["rank"]) for r in cand.rare_key_join(frame(q), frame(p), spark.createDataFrame([("b", 40)], "block string, n_pool long"), 5, 12, 3).collect()}
    df = {k: sum(k in v for v in p.values()) for k in range(30)}
    want = {}
    for s, ks in q.items():
        rare = sorted((df[k], at, k) for at, k in enumerate(ks) if 0 < df[k] <= 12)[:3]
        score = {r: sum(log(41 / d) for d, _, k in rare if k in v) for r, v in p.items()}
        for rank, (r, x) in enumerate(sorted(((r, x) for r, x in score.items() if x), key=lambda y: (-round(y[1], 9), int(y[0][1:])))[:5]):
            want[(s, r)] = (round(x, 6), rank)
    assert got == want


def test_prune_keeps_pairs_of_several_channels(spark):
    df = spark.createDataFrame([("a", f"r{i}", 2 if i < 4 else 1, i, 1.0) for i in range(10)], "s1 string, r string, n_channels int, min_rank int, max_score double")
    assert {r.r for r in cand.prune(df, 2).collect()} == {"r0", "r1", "r2", "r3"}
    assert {r.r for r in cand.prune(df, 6).collect()} == {f"r{i}" for i in range(6)}


def test_ranges_give_the_same_neighbours(spark):
    """Many records share a key and the beginning of others; the ranges cut through them."""
    rows = [("b", f"{'S1' if i % 3 == 0 else 'S2'}-{i}", "the " + ("same" if i % 2 else f"name {i % 11}"), "us" if i % 5 else "fr", i) for i in range(240)]
    df = spark.createDataFrame(rows, "block string, entity_id string, name_core string, country_norm string, row_ord long")
    a, b = df.where("entity_id like 'S1%'"), df.where("entity_id like 'S2%'")
    one, many = ({tuple(r) for r in ch.sorted_neighbourhood(a, b, 7, chunk).collect()} for chunk in (10_000, 30))
    assert one and one == many


def test_siblings(spark, small):
    rows = [("S2-1", "Nova Labs Ltd", "1 A", "US", "S2", 1), ("S3-1", "Nova Labs", "2 B", "US", "S3", 2), ("S3-2", "Other", "", "US", "S3", 3)]
    pool = canonicalize(spark.createDataFrame(rows, KIND))
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0)], "s1 string, r string, min_rank int")
    assert [(r.s1, r.r) for r in cand.siblings(pairs, pool).collect()] == [("S1-1", "S3-1")]


def test_feature_counts_and_ranges(spark, made):
    s1, pool, _ = made
    df, n = feat.document_frequency(s1.select("name_core_tokens", "addr_tokens").unionByName(pool.select("name_core_tokens", "addr_tokens")))
    pruned, _ = cand.block_and_prune(s1, pool, 10, channels=["c1_exact", "c3_rare"])
    pairs = pruned.withColumn("cand_count", F.lit(3)).select("s1", "r", "mask", "rank", "cand_count")
    full = feat.pair_features(feat.attach(pairs, feat.with_idf(s1, df, n), feat.with_idf(pool, df, n)))
    names = [c for c in full.columns if c not in ("s1", "r")]
    assert len(names) == 81 and len(feat.light_features(full).columns) - 2 == 47
    rows = full.collect()
    for r in rows:
        assert all(x is not None for x in r)
        assert all(-1e-9 <= r[c] <= 1 + 1e-9 for c in names if c.endswith(("_eq", "_conflict", "_sim")) or "ratio" in c or "jaccard" in c or "monge" in c)
    assert feat.monotone_signs(["house_conflict", "name_jw_core", "rank_c1"]) == [-1, 1, 0]


def brute_expected(ps, lam):
    missed = np.array([np.exp(-lam) * lam**j / f for j, f in enumerate((1, 1, 2, 6))])
    missed /= missed.sum()
    best = (0, -1.0)
    for k in range(len(ps) + 1):
        v = 0.0
        for world in itertools.product((0, 1), repeat=len(ps)):
            w = np.prod([p if x else 1 - p for p, x in zip(ps, world)])
            for j, m in enumerate(missed):
                g, a = sum(world) + j, sum(world[:k])
                v += w * m * ((1.0 if g == 0 else 0.0) if k == 0 else 5 * a / (4 * k + g))
        if v > best[1] + 1e-12:
            best = (k, v)
    return best


def test_best_prefix_against_enumeration():
    rng = random.Random(5)
    for _ in range(40):
        ps = np.array(sorted((rng.random() for _ in range(rng.randrange(1, 6))), reverse=True))
        k, v = decide.best_prefix(ps, 0.03)
        assert (k, pytest.approx(v)) == brute_expected(ps, 0.03)
    assert decide.best_prefix(np.array([0.05, 0.02, 0.01]), 0.03)[0] == 0 and decide.best_prefix(np.array([0.92, 0.1]), 0.03)[0] == 1


def test_decisions(spark):
    df = spark.createDataFrame([("a", "x", 0.55), ("a", "y", 0.6), ("b", "x", 0.85), ("c", "x", 0.75)], "s1 string, r string, p double")
    rows = lambda d: {(r.s1, r.r): r.p for r in d.collect()}
    assert set(rows(decide.two_thresholds(df.where("s1 = 'a'"), first=0.5, extra=0.7))) == {("a", "y")}
    assert set(rows(decide.top1_threshold(df, threshold=0.58))) == {("a", "y"), ("b", "x"), ("c", "x")}
    soft = rows(decide.exclusivity(df))
    assert soft[("b", "x")] == 0.85 and soft[("a", "x")] == 0.0 and soft[("c", "x")] == 0.375
    hard = decide.exclusivity(df, hard=True)
    assert rows(hard)[("c", "x")] == 0.0 and rows(decide.exclusivity(hard, hard=True)) == rows(hard)
    assert set(rows(decide.exclusive_after(df))) == {("a", "y"), ("b", "x")}
    assert ("b", "x") in rows(decide.expected_f05(df))


def test_sweeps_agree_with_the_rules(spark):
    rng = random.Random(9)
    pairs = [(f"s{i}", f"r{j}", round(rng.random(), 4), int(rng.random() < 0.3)) for i in range(12) for j in range(rng.randrange(4))]
    df = spark.createDataFrame(pairs, "s1 string, r string, p double, y int")
    links = {s: sum(y for t, _, _, y in pairs if t == s) for s in {f"s{i}" for i in range(12)}}
    sizes = spark.createDataFrame(list(links.items()), "s1 string, g int")
    gold = df.where("y = 1").select("s1", "r")
    for rule, grid, fn in (("global", [(0.3,), (0.6,)], lambda g: decide.global_threshold(df, threshold=g[0])), ("two_threshold", [(0.4, 0.5), (0.6, 0.8)], lambda g: decide.two_thresholds(df, first=g[0], extra=g[1])), ("expected_f", [(0.0,), (1.0,)], lambda g: decide.expected_f05_meanfield(df, beta=g[0]))):
        swept = {tuple(r[c] for c in r.asDict() if c != "macro_f05"): r.macro_f05 for r in decide.sweep(df, sizes, rule, grid).collect()}
        for g in grid:
            want = metrics.macro(metrics.per_entity(sizes, fn(g), gold)).first().macro_f05
            assert swept[g] == pytest.approx(want)
    assert {k: len(v) for k, v in decide.grids().items()} == {"global": 91, "two_threshold": 306, "expected_f": 41, "cv_global": 27, "cv_two_threshold": len(decide.grids()["cv_two_threshold"])}


def test_f05(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1 string")
    link = lambda *x: spark.createDataFrame(list(x), "s1 string, r string")
    pred, gold = link(("b", "1"), ("c", "2"), ("d", "7"), ("d", "8"), ("d", "9")), link(("b", "1"), ("c", "2"), ("c", "3"), ("d", "7"), ("d", "9"))
    got = {r.s1: r.f05 for r in metrics.per_entity(e, pred, gold).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": pytest.approx(5 / 6), "d": pytest.approx(5 / 7)}
    m = metrics.macro(metrics.per_entity(e.where("s1 <> 'd'"), pred, gold)).first()
    assert m.macro_f05 == pytest.approx((1 + 1 + 5 / 6) / 3) and m.singleton_accuracy == 1.0 and m.n_singletons == 1
    assert metrics.per_entity(e, link(("a", "1")), link(("b", "1"))).where("f05 <> 0").select("s1").first() is not None
    b = metrics.bootstrap_difference(metrics.per_entity(e, pred.where("s1 <> 'b'"), gold), metrics.per_entity(e, pred, gold))
    assert b["observed_mean_delta"] == pytest.approx(0.25) and b["ci_lower"] <= 0.25 <= b["ci_upper"]


def test_calibration_figures(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, 1.0), (0, 0.35), (1, 0.35)], "y int, p double")
    assert metrics.auc(df).first().auc == pytest.approx(5.5 / 6) and metrics.calibration_bins(df).where("bin = 9").first().n == 2
    assert metrics.auc(df.where("y = 1")).first().auc is None
    assert metrics.ece(df).first().ece == pytest.approx((0.1 + abs(0.95 - 1) * 2 + abs(0.35 - 0.5) * 2) / 5)


def test_errors_and_gates(spark, small):
    s1, pool = small
    link = lambda *x: spark.createDataFrame(list(x), "s1 string, r string")
    tags = {(r.s1, r.r, r.tag) for r in metrics.error_tags(link(("S1-3", "S3-30"), ("S1-1", "S2-10")), link(("S1-2", "S2-20")), link(("S1-1", "S2-10"), ("S1-2", "S2-20")), s1, pool).collect()}
    assert tags == {("S1-3", "S3-30", "false_positive"), ("S1-3", "S3-30", "singleton_violation"), ("S1-2", "S2-20", "decision_miss")}
    g = checks.decision_gates(s1, pool, link(("S1-1", "S2-10"), ("S1-2", "S2-20")), s1.select(F.col("entity_id").alias("s1"))).first()
    assert g.g1_exclusive and g.same_country_rate == 1.0 and g.postal_rate == 1.0 and g.multi_match_share == 0.0 and g.singleton_rate == pytest.approx(1 / 3)
    bad = spark.createDataFrame([("S2-1", "a", "b", "c", "S1", 0), ("S1-1", "a\x01", "", "", "S1", 1), ("S1-1", "a", "b", "c", "S1", 2)], KIND)
    r = checks.record_report(bad).first()
    assert (r.wrong_prefixes, r.repeated_ids, r.control_characters, r.empty_addresses) == (1, 1, 1, 1)
    with pytest.raises(checks.InputError):
        checks.validate_records(bad)


def test_group_context(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.5), ("b", "x", 0.2)], "s1 string, r string, p double")
    got = {(r.s1, r.r): r for r in feat.group_context(df).collect()}
    assert got[("a", "x")].rev_gap == pytest.approx(0.7) and got[("b", "x")].rev_gap == pytest.approx(-0.7) and got[("a", "y")].p_gap_to_best == pytest.approx(0.4)
    assert got[("a", "x")].n_above_half_in_s1 == 2 and got[("b", "x")].p_second_in_s1 == 0.0
    c = {(r.s1, r.r): r for r in feat.columnar_context(df, "p").collect()}
    assert c[("a", "y")].rank2a == 2 and c[("a", "y")].n_above50 == 1 and c[("a", "x")].p_second == 0.5


def test_running_sums_in_two_levels(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(300)]
    got = {(r.k, r.i): r.s for r in running_sums(spark.createDataFrame(rows, "k string, i long, v long").withColumn("chunk", F.floor(F.col("i") / 37)), ["k"], "chunk", ["i"], {"s": "v"}).collect()}
    seen = {"a": 0, "b": 0}
    for k, i, v in rows:
        assert got[(k, i)] == seen[k]
        seen[k] += v


def test_mined_abbreviations(spark):
    pos = spark.createDataFrame([("acme pvt", "acme private")] * 6, "a string, b string")
    neg = spark.createDataFrame([("x y", "z w")], "a string, b string")
    assert [(r.short, r.long, r["count"]) for r in feat.abbreviations(pos, neg).collect()] == [("pvt", "private", 6)]


def test_first_come_lists_and_countries(spark, made, tmp_path):
    import zipfile

    from entwine.sources import tables

    df = spark.createDataFrame([("b", "x", 0.9, 1), ("a", "x", 0.2, 0), ("b", "y", 0.5, 1)], "s1 string, r string, p double, row_ord int")
    assert {(r.s1, r.r) for r in decide.first_come(df).collect()} == {("a", "x"), ("b", "y")}
    assert {r.s1: r.ps for r in decide.probability_lists(df).collect()} == {"a": [0.2], "b": [0.9, 0.5]}
    counts = tables.countries(made[0]).collect()
    assert sum(r.n for r in counts) == 60 and counts[0].n >= counts[-1].n
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("a")
    tables.package([str(tmp_path / "d")], str(tmp_path / "z.zip"))
    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["d/a.txt"]


def test_hot_keys_keep_the_first_records(spark):
    """A name that every record has: capped postings give what the whole posting would."""
    rows = lambda source, n: [(f"{source}-{i}", "Star Mart", f"{i} A St, 12345" if i % 2 else "", "US", source, i) for i in range(n)]
    a, b = (canonicalize(spark.createDataFrame(rows(s, n), KIND)).withColumn("block", F.lit("us")) for s, n in (("S1", 3), ("S2", 400)))
    for fn, k in ((ch.exact, 50), (ch.phonetic, 15), (ch.address, 30)):
        got = fn(a, b).groupBy("s1").agg(F.count("*").alias("n"), F.max("rank").alias("m")).collect()
        assert got and all(r.n <= k and r.m == r.n - 1 for r in got)
    ranked = ch.exact(a, b).where("s1 = 'S1-0'").orderBy("rank").select("r").collect()
    assert [r.r for r in ranked] == [f"S2-{i}" for i in range(50)]
