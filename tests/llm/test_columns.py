"""Stages of the pipeline: columns with any name pass unchanged, empty tables stay empty, odd rows have their defined results."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entwine.llm import quality

NAMES = "score predicted offending _1 _2 _id _kept _nth _own _copies _copy _rows _k1 _k2 _alone k1 k2 id class_id row_id starts c0 c3 kept failed value_symbols _c".split()
ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["ore", "ill", "und", "ast"]) + str(rng.randrange(500))
    rows = [[i, " ".join(word() for _ in range(70)) + (" you fool." if i % 5 == 0 else "."), "en", f"s{i % 2}", 1] for i in range(60)]
    rows += [[100, rows[1][1], "en", "s0", 1], [101, None, None, None, None], [None, rows[2][1], "en", None, 1], [None, "lost row " * 30, None, None, 1], [102, "", "en", "s1", 0], rows[3], rows[3]]
    d = str(tmp_path_factory.mktemp("columns"))
    spark.createDataFrame([(r[0], int("fool" in (r[1] or "")), 1) for r in rows if r[0] is not None], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame(rows, ROWS)
    docs.write.parquet(f"{d}/documents.parquet")
    return d, docs.select("*", *(F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_pass_unchanged(spark, tables, name):
    d, docs = tables
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, d)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    rows = got.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for n in NAMES)
    plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), d)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect())
    assert stage(spark, docs.where("false"), d).collect() == []


def test_last_stage_and_empty_pipeline(spark, tables, tmp_path):
    d, docs = tables
    got = corpus_pipeline.tokenize(spark, docs, d)
    assert got.count() == docs.count() and corpus_pipeline.tokenize(spark, docs.where("false"), d).count() == 0
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_quality_rule_rejects(spark):
    rng = random.Random(5)
    word = lambda n=5: "".join(rng.choices("abcdefghijklmnop", k=n))
    text = lambda: " ".join(word() for _ in range(200))
    rows = [(i, text(), "en", "a") for i in range(150)]
    odd = {
        "symbols": text() + " #*$%" * 60,
        "dup_lines": "\n".join([word(9), *[text()[:90] for _ in range(8)], *["the same line"] * 9]),
        "repeats": text() + " one two three four" * 20,
        "shouting": text().upper(),
        "word_length": " ".join(word(30) for _ in range(200)),
    }
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(odd.values())] + [(2000, " ".join(word(1) + word(1) for _ in range(200)), "en", "a")]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, ROWS.rpartition(",")[0])).collect()}
    for i, name in enumerate(odd):
        assert name in got[1000 + i].failed and not got[1000 + i].kept, name
    assert got[2000].failed == ["word_length"] and all(got[i].kept for i in range(150))


def test_sketches_merge_to_the_same_and_keep_their_error(spark):
    rng = random.Random(9)
    values = [int(10 ** rng.uniform(0, 9)) for _ in range(3000)] + list(range(300)) + [2**k + d for k in range(7, 50) for d in (-1, 0, 1)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.least_of(quality.cell(F.col("v"))).alias("low"), quality.cell(F.col("v")).alias("cell"))
    rows = sorted(df.collect())
    assert all(r.low <= r.v and r.v - r.low <= r.v / 64 for r in rows)
    assert all(a.cell <= b.cell and a.low <= b.low for a, b in zip(rows, rows[1:]))
