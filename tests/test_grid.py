"""Channels that score all pairs of a block keep them where they are scored."""

import random

from entwine.operators import channels as ch, grid


def records(spark, n, words):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        toks = [rng.choice(words) for _ in range(3)] + ["haus"]
        rows.append((f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", i, "x", " ".join(toks), toks))
    df = spark.createDataFrame(rows, "entity_id string, source string, row_ord long, block string, name_norm string, name_core_tokens array<string>")
    return df.where("source = 'S1'"), df.where("source <> 'S1'")


def shuffled(spark, run):
    """Rows that are shuffled while `run` runs, and its result."""
    sc = spark.sparkContext
    sc.setJobGroup(name := f"grid-{random.random()}", "")
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    try:
        out = run()
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    done = [store.lastStageAttempt(s) for s in stages]
    return sum(s.shuffleWriteRecords() for s in done), out


def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abdeilmnorst") for _ in range(4)) for _ in range(60)]


def test_pairs_that_share_an_ngram_are_not_shuffled(spark):
    s1, pool = records(spark, 900, words())
    n, rows = shuffled(spark, lambda: ch.tfidf(s1, pool, k=5).collect())
    assert len(rows) == 300 * 2 * 5
    assert n < 60_000  # the pairs alone are 180,000


def test_pairs_that_share_a_token_are_not_shuffled(spark):
    s1, pool = records(spark, 900, words())
    n, rows = shuffled(spark, lambda: ch.token_overlap(s1, pool, k=5).collect())
    assert len(rows) == 300 * 5
    assert n < 30_000  # 300 S1 meet 500 records each by the common token


def test_cells_of_any_size_agree(spark, monkeypatch):
    s1, pool = records(spark, 300, words()[:6])  # many equal names and equal scores
    both = lambda: [sorted(map(tuple, f(s1, pool, k=7).collect())) for f in (ch.tfidf, ch.token_overlap)]
    want = both()
    whole = grid.cells
    monkeypatch.setattr(ch, "cells", lambda *a, **b: whole(*a, **b, chunks=(13, 29)))
    assert both() == want
