"""The language model does not depend on partitions; a document's score equals a plain sum over its tokens."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from entwine.llm import language_model as lm


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    follow = {w: [f"{w}{x}" for x in "abc"] for w in "pqrstuvw"}
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randrange(1, 60)):
            w = rng.choice("pqrstuvw")
            words += [w, rng.choice(follow[w]), f"rare{rng.randrange(400)}"]
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "Long ONE " * 30_000), (203, "never seen wörter"), (None, "p pa"), (5, rows[5][1]), (5, rows[5][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


SHAPE = lm.Shape(shortlist=12, buckets=6, dim=6, head=25)


def test_partitions_do_not_matter(spark, corpus):
    _, df = corpus
    models = [lm.fit(df.repartition(n), SHAPE, shard=6000) for n in (1, 16)]
    assert all((models[0].params[k] == models[1].params[k]).all() for k in models[0].params)
    a, b = ({(r.doc_id, r.score) for r in lm.score(df, m).collect()} for m in models)
    assert sorted(round(s, 6) for _, s in a) == sorted(round(s, 6) for _, s in b)


def test_scores_equal_plain_sums(spark, corpus):
    rows, df = corpus
    model = lm.fit(df.where("doc_id < 150 or doc_id is null"), SHAPE, shard=6000)
    train = [t for i, t in rows if i is None or i < 150]
    count = Counter(w for t in train for w in lm.words_of(t))
    ends = len(train)
    ranked = sorted(count, key=lambda w: (-count[w], w))
    class_of = {w: i for i, w in enumerate(ranked[: SHAPE.shortlist])}
    of = lambda w: class_of.get(w, SHAPE.shortlist + lm.bucket_of(w, SHAPE.buckets))
    mass = np.zeros(SHAPE.classes)
    for w, c in count.items():
        mass[of(w)] += c + 0.5
    mass[SHAPE.shortlist : SHAPE.end] += 0.5
    p = {k: x.astype(float) for k, x in model.params.items()}
    want = Counter()
    for i, t in rows:
        words = lm.words_of(t)
        classes = [SHAPE.end, SHAPE.end, *map(of, words), SHAPE.end]
        total = 0.0
        table = {}
        for j, (u, v, w) in enumerate(zip(classes, classes[1:], classes[2:])):
            if (u, v) not in table:
                s = (p["a"] * p["r"][u] + p["b"] * p["r"][v]) @ p["q"].T + p["bias"]
                table[u, v] = s - math.log(np.exp(s).sum())
            total += table[u, v][w]
            if j < len(words):
                total += math.log((count[words[j]] + 0.5) / mass[w])
        want[i, round(total / math.log(10) / max(1, len(words)), 4)] += 1
    got = lm.score(df, model).collect()
    assert Counter((r.doc_id, round(r.score / max(1, r.n_tokens - 1), 4)) for r in got) == want
    assert ends == sum(1 for _ in train) and model.total == sum(count.values()) + ends


def test_probabilities_of_all_words_sum_to_one(spark, corpus):
    """After any context: every known word, one unknown word of each bucket, and the end."""
    _, df = corpus
    model = lm.fit(df, SHAPE, shard=6000)
    counts = {r.word: r.c for r in model.counts.collect()}
    share = np.zeros(SHAPE.classes)
    for w, c in counts.items():
        k = SHAPE.end if w == lm.END else lm.Lexicon(model.head, SHAPE)[w.encode()] // lm.NO_INDEX
        share[k] += (c + 0.5) / math.exp(model.log_mass[k])
    share[SHAPE.shortlist : SHAPE.end] += 0.5 / np.exp(model.log_mass[SHAPE.shortlist : SHAPE.end])
    assert np.allclose(share, 1)
    p = model.params
    for u, v in ((0, 1), (SHAPE.end, SHAPE.end), (9, 3)):
        s = (p["r"][u] * p["a"] + p["r"][v] * p["b"]) @ p["q"].T + p["bias"]
        assert abs(np.exp(s - model.log_z[u, v]).sum() - 1) < 1e-4


def test_ids_of_any_type_and_no_rows(spark):
    df = spark.createDataFrame([("x", "a b", 1), (None, "a", 2)], "doc_id string, text string, word long")
    model = lm.fit(df, SHAPE)
    assert {r.doc_id: r.n_tokens for r in lm.score(df, model).collect()} == {"x": 3, None: 2}
    assert lm.score(df.where("false"), model).collect() == [] and lm.fit(df.where("false"), SHAPE).total == 0


def test_shortlist_grows_with_tokens():
    sizes = [lm.shape_for(n).shortlist for n in (0, 10**6, 10**7, 10**8, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 384 and sizes[-1] == 1920
