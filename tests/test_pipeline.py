"""Files in, files out: readers, writers, the cascade, the command line and the stream."""

import pathlib

import pytest
from pyspark.sql import functions as F

from entwine.plans import cli, config, pipeline, registry
from entwine.sources import synthetic, tables


def write(path: pathlib.Path, *lines: str) -> str:
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_reading_keeps_quotes_and_words_for_nothing(spark, tmp_path):
    p = write(tmp_path / "a.tsv", "﻿" + "\t".join(tables.RECORD.names), "S1-1\tNA\tNone\tNull", 'S1-2\t"Quoted Business"\t"open\t', "S1-3\tshort")
    rows = tables.read_records(spark, p, "S1").orderBy("row_ord").collect()
    assert [(r.business_name, r.business_address, r.country) for r in rows] == [("NA", "None", "Null"), ('"Quoted Business"', '"open', ""), ("short", "", "")]
    assert tables.read_records(spark, p, "S1", malformed="drop").count() == 2
    with pytest.raises(Exception, match="number of fields"):
        tables.read_records(spark, p, "S1", malformed="fail").collect()
    with pytest.raises(tables.HeaderError):
        tables.read_links(spark, p)


def test_links_keep_entities_without_any(spark, tmp_path):
    p = write(tmp_path / "g.tsv", "\t".join(tables.LINKS.names), "S1-1\tS2-1, S3-2,,", "S1-2\t")
    entities, gold = tables.read_links(spark, p)
    assert [r.s1 for r in entities.orderBy("row_ord").collect()] == ["S1-1", "S1-2"]
    assert sorted((r.s1, r.r) for r in gold.collect()) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]


def test_results_are_written_in_order_and_checked(spark, tmp_path):
    entities = spark.createDataFrame([("S1-001", 0), ("S1-002", 1), ("S1-003", 2)], "s1 string, row_ord long")
    link = lambda *x: spark.createDataFrame(list(x), "s1 string, r string")
    pairs = link(("S1-001", "S2-10"), ("S1-002", "S2-30"), ("S1-002", "S2-30"))
    tables.write_results(entities, pairs, pairs, str(tmp_path))
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/matching_results").collect()]
    assert lines == ["source1_entity_id\tmatched_entity_ids", "S1-001\tS2-10", "S1-002\tS2-30", "S1-003\t"]
    for bad in (dict(matches=link(("S1-001", "S3-1"))), dict(candidates=link(("S1-001", "S1-2"))), dict(valid=spark.createDataFrame([("S2-10",)], "entity_id string"))):
        with pytest.raises(tables.ContractError):
            tables.check_output(entities, bad.get("candidates", pairs), bad.get("matches", pairs), bad.get("valid"))
    with pytest.raises(tables.ContractError):
        tables.check_output(entities.union(entities), pairs, pairs)


def test_parquet_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", "S1", "us"), ("b", "test", "S2", "fr")], "entity_id string, split string, source string, country_norm string")
    tables.write_normalised(df, str(tmp_path / "n"))
    assert [r.entity_id for r in tables.read_normalised(spark, str(tmp_path / "n"), "train", ["S1"], "us", ["entity_id"]).collect()] == ["a"]


def test_samples_and_cohorts(spark):
    s1, pool, gold = synthetic.registry(spark, 20, seed=1)
    entities = s1.select(F.col("entity_id").alias("s1"), "row_ord")
    c = tables.cohort(entities, gold, pool, 5, 10, 6)
    assert c["val_entities"].count() == 5 and c["train_entities"].count() == 10
    assert {r.s1 for r in c["val_gold"].collect()} <= {r.s1 for r in c["val_entities"].collect()}
    kept = tables.keyed_sample(pool, gold.select(F.col("r").alias("entity_id")), 3)
    assert kept.count() == gold.select("r").distinct().count() + 3
    assert tables.distinct_gather(pool, ["country"], lambda d: d.withColumn("n", F.length("country"))).count() == pool.count()


@pytest.mark.parametrize("scheme", ["full", "columnar"])
def test_cascade_beats_nothing_and_can_be_reloaded(spark, tmp_path, scheme):
    from entwine.operators import learn, metrics

    s1, pool, gold = synthetic.registry(spark, 36, seed=3)
    r = pipeline.Records(s1.select(F.col("entity_id").alias("s1"), "row_ord"), s1, pool, gold)
    c = config.Config(scheme=scheme, channels=("c1_exact", "c3_rare"), budget=8, folds=2, boosting_rounds=2, tree_depth=3)
    matcher, report = pipeline.train(r, c)
    assert report["macro_f05"] > 0.6 and report["pair_completeness"] > 0.8
    matcher.save(str(tmp_path / "m"))
    again = learn.Matcher.load(spark, str(tmp_path / "m"))
    assert again.columns == matcher.columns and again.beta == matcher.beta
    candidates, matches = pipeline.predict(r, again, c)
    assert matches.join(candidates, ["s1", "r"], "left_anti").count() == 0
    assert matches.groupBy("r").count().where("count > 1").count() == 0 or scheme
    assert metrics.macro(metrics.per_entity(r.entities, matches, gold)).first().macro_f05 > 0.6


def test_command_line_round_trip(spark, tmp_path, capsys):
    d = str(tmp_path)
    cli.generate(spark, d, 20, 15, 42)
    r = pipeline.read_split(spark, f"{d}/test", "test")
    assert r.s1.count() == 15
    pairs = pipeline.baseline(r)
    tables.write_results(r.entities, pairs, pairs, f"{d}/out", r.pool)
    args = ["validate", "--matching", f"{d}/out/matching_results", "--candidates", f"{d}/out/candidate_pairs", "--test-dir", f"{d}/test", "--check-ids"]
    stop, cli.session = cli.session, lambda: spark
    try:
        assert cli.main(args) == 0 and "PASS" in capsys.readouterr().out
        bad = write(tmp_path / "bad.tsv", "source1_entity_id\tmatched_entity_ids", "S1-00001\tS2-99999,S2-99999", "S1-00001\t", "S1-77777\tS1-1,X", "oops")
        assert cli.main([*args[:2], bad, *args[3:]]) == 1
        found = capsys.readouterr().out
        assert all(w in found for w in ("repeated_row", "repeated_id", "self_match", "wrong_prefix", "unknown_id", "missing_entity", "extra_entity", "malformed_row"))
    finally:
        cli.session = stop


def test_settings(tmp_path):
    assert pipeline.pick_steps("from:predict") == ["predict", "write"] and pipeline.pick_steps("write,train") == ["train", "write"]
    with pytest.raises(ValueError):
        pipeline.pick_steps("nothing")
    c = config.load(write(tmp_path / "c.yaml", "budget: 7  # fewer", "scheme: columnar", 'channels: ["c1_exact"]'))
    assert (c.budget, c.scheme, c.channels) == (7, "columnar", ("c1_exact",)) and config.load(None) == config.Config()
    with pytest.raises(ValueError):
        config.Config().merged({"unknown": 1})


def test_arriving_entities_are_blocked(spark, tmp_path):
    from entwine.operators.canonical import canonicalize
    from entwine.streaming.matching import match_stream

    s1, pool, _ = synthetic.registry(spark, 12, seed=5)
    s1.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(s1.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = match_stream(arriving, canonicalize(pool), lambda pairs, n: pairs.write.mode("overwrite").parquet(f"{out}/{n}"), ["c1_exact", "c8_token_overlap"]).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/*").count() > 0


def test_every_query_is_registered_once():
    q, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 45
