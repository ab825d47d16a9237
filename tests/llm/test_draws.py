"""The language model's draws of noise are those of numpy's choice, without its sums for each batch."""

import numpy as np
import pytest

from entwine.llm import language_model as lm


@pytest.mark.parametrize("seed", range(5))
def test_training_by_kept_sums_is_the_same(seed):
    shape = lm.Shape(shortlist=40, buckets=8, dim=4)
    rng = np.random.default_rng(seed)
    p = rng.random(shape.classes)
    p /= p.sum()
    u, v, w = (rng.integers(0, shape.classes, 200) for _ in range(3))
    cdf = p.cumsum()
    cdf /= cdf[-1]
    found = []
    for more in ({}, {"cdf": cdf}):
        params, draws = lm.start(shape, np.log(p)), np.random.default_rng([11, seed])
        state = {k: np.full(x.shape, 1e-6, np.float32) for k, x in params.items()}
        for _ in range(5):
            lm.nce_pass(params, np.log(p).astype(np.float32), p, u, v, w, draws, state, **more)
        found.append(params)
    assert all(np.array_equal(found[0][k], found[1][k]) for k in found[0])


def test_batches_without_rare_words_or_rows(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, None), (3, "")], "doc_id long, text string")
    model = lm.fit(docs)
    rows = {r.doc_id: (r.n_tokens, r.n_known) for r in lm.score(docs, model).collect()}
    assert rows == {1: (4, 4), 2: (1, 1), 3: (1, 1)}
    assert lm.score(docs.limit(0), model).count() == 0
