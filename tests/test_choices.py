"""The choice of a rule, early stopping, importances, countries left out, the light scheme, cohorts and reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from entwine.operators import decide, learn
from entwine.plans import config, pipeline
from entwine.sources import synthetic


def test_all_settings_at_once_equal_one_by_one():
    rng = np.random.default_rng(1)
    betas, lams = np.array([-1.0, 0.0, 0.7]), np.array([0.005, 0.04])
    for n in (1, 2, 5, 14, 17):
        ps = np.sort(rng.random(n))[::-1] * rng.choice([1, 0.3])
        got = decide.best_prefixes(ps, betas, lams)
        for i, b in enumerate(betas):
            clipped = np.clip(ps, 1e-7, 1 - 1e-7)
            q = 1 / (1 + np.exp(-(np.log(clipped / (1 - clipped)) + b)))
            assert [decide.best_prefix(q, lam)[0] for lam in lams] == got[i].tolist()


def test_exact_sweep_equals_deciding_under_each_setting(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", f"r{i}_{j}", float(rng.random()), int(rng.random() < 0.4)) for i in range(30) for j in range(int(rng.integers(0, 6)))]
    pairs = spark.createDataFrame(rows, "s1 string, r string, p double, y int")
    sizes = spark.createDataFrame([(f"s{i}", sum(y for s, _, _, y in rows if s == f"s{i}") + (i % 7 == 0)) for i in range(30)], "s1 string, g long")
    g = {r.s1: r.g for r in sizes.collect()}
    truth = {(s, r): y for s, r, _, y in rows}
    swept = {(round(r.x0, 3), round(r.x1, 3)): r.macro_f05 for r in decide.sweep_exact(pairs, sizes, [-0.5, 0.6], [0.01, 0.04]).collect()}
    assert len(swept) == 4
    for (beta, lam), score in swept.items():
        chosen = [(r.s1, r.r) for r in decide.decide(pairs, "exact", (beta, lam)).collect()]
        total = 0.0
        for s, n in g.items():
            mine = [c for c in chosen if c[0] == s]
            tp = sum(truth[c] for c in mine)
            total += float(not mine) if n == 0 else 5 * tp / (4 * len(mine) + n)
        assert abs(total / 30 - score) < 1e-9


def test_the_best_rule_is_chosen(spark):
    pairs = spark.createDataFrame([(f"s{i}", f"r{i}", 0.9 if i % 2 else 0.2, i % 2) for i in range(20)], "s1 string, r string, p double, y int")
    sizes = spark.createDataFrame([(f"s{i}", i % 2) for i in range(20)], "s1 string, g int")
    found = decide.tune(pairs, sizes, ("global", "two_threshold", "expected_f", "exact"))
    assert all(score == 1.0 for _, score in found.values()) and 0.2 < found["global"][0][0] <= 0.9
    for rule, (params, _) in found.items():
        assert {r.s1 for r in decide.decide(pairs, rule, params).collect()} == {f"s{i}" for i in range(1, 20, 2)}
    with pytest.raises(ValueError):
        decide.decide(pairs, "none", ())


def test_trees_stop_early_and_say_what_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", float(rng.random()), float(rng.random()), ("us", "india", "france")[i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "s1 string, a double, b double, country_norm string").withColumn("y", (F.col("a") > 0.5).cast("int"))
    noisy = df.withColumn("y", F.when(F.pmod(F.xxhash64("s1"), F.lit(3)) == 0, 1 - F.col("y")).otherwise(F.col("y")))
    s = learn.Settings(rounds=12, depth=2)
    model = learn.fit_trees(noisy, ["a", "b"], s)
    assert model.stages[-1].getNumTrees < 12 and learn.fit_trees(df, ["a", "b"], learn.Settings(rounds=3, depth=2, early=False)).stages[-1].getNumTrees == 3
    assert learn.importances([model], ["a", "b"])[0][0] == "a"
    aucs = learn.country_aucs(df.drop("country_norm"), df.select("s1", "country_norm"), ["a", "b"], learn.Settings(rounds=2, depth=2))
    assert [c for c, _ in aucs] == ["france", "india", "us"] and all(x > 0.99 for _, x in aucs)


def test_the_light_scheme_runs(spark):
    s1, pool, gold = synthetic.registry(spark, 24, seed=4)
    r = pipeline.Records(s1.select(F.col("entity_id").alias("s1"), "row_ord"), s1, pool, gold)
    c = config.Config(scheme="light", folds=2, boosting_rounds=2, tree_depth=2, rules=("global", "exact"), exclusive_after=True)
    matcher, report = pipeline.train(r, c)
    assert report["macro_f05"] > 0.4 and report["pair_completeness"] > 0.8 and report["rule"] in ("global", "exact") and len(matcher.columns) == 47
    _, matches = pipeline.predict(r, matcher, c)
    assert matches.groupBy("r").count().where("count > 1").count() == 0


def test_cohorts_and_saved_models(spark, tmp_path):
    from entwine.plans import cli

    d = str(tmp_path)
    cli.generate(spark, d, 24, 10, 7)
    c = config.Config(train_dir=f"{d}/train", test_dir=f"{d}/test", output_dir=f"{d}/out", model_dir=f"{d}/model", channels=("c1_exact", "c3_rare"), folds=2, boosting_rounds=1, tree_depth=2, early_stopping=False)
    report = pipeline.cohort_run(spark, c, 8, 16, 8)
    assert report["validation"]["n"] == 8 and report["train"]["n"] == 16 and 0 <= report["validation"]["pair_completeness"] <= 1
    assert report["train"]["importances"]
    full = pipeline.run(spark, c, "predict,write", lambda *_: None)
    again = pipeline.scores(pipeline.read_split(spark, f"{d}/train", "train"), pipeline.learn.Matcher.load(spark, f"{d}/model"), c, "evaluation")
    assert again["n"] == 24
    assert full["outputs"]["bad_prefixes"] == full["outputs"]["unknown_ids"] == full["outputs"]["outside_candidates"] == 0
    assert json.loads(spark.read.text(f"{d}/out/report").first()[0])["n_matches"] == full["n_matches"]
