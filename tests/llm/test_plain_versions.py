"""The registered toxicity scores and shards against plain versions of what their models and laws say."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from entwine.llm import queries, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["on", "ul", "et"]) + str(rng.randrange(60))
    rows = []
    for i in range(400):
        sentences = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 9))]
        if i % 5 == 0:
            sentences.insert(rng.randrange(len(sentences) + 1), "You " + rng.choice(["horrid", "horridly", "vile"]) + " " + word())
        rows.append((i, rng.choice([". ", "\n", "! "]).join(sentences) + "."))
    rows += [(500, None), (501, ""), (502, "...\n"), (503, "VILE " * 3000), (504, "İVİLE ẞtraße horrid"), (7, rows[7][1]), (505, rows[8][1])]
    d = str(tmp_path_factory.mktemp("plain"))
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_toxicity_scores_are_noisy_or_of_sentences(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = toxicity.training_labels(spark.read.parquet(f"{d}/labels.parquet"))
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in labels.collect())
    model = toxicity.fit(docs, labels)
    assert model.weights

    def plain(text):
        keep, sentences = 1.0, [s for s in re.split(r"[.!?\n]+", (text or "").lower()) if s] or [""]
        for s in sentences:
            z = model.bias
            for w in re.findall(r"\w+", s):
                z += sum(model.weights.get(f, 0.0) for f in [w, *(w[:n] + "*" for n in (4, 6) if len(w) > n)])
            keep *= 1 / (1 + math.exp(min(z, 700)))
        return 1 - keep

    want = Counter((i, round(plain(t), 6)) for i, t in rows)
    got = queries.op2_toxicity(spark, d).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_shards_of_the_query_are_even(spark, folder):
    d, rows = folder
    got = queries.op8_sharding(spark, d).collect()
    size = {s: 0 for s in range(16)}
    for r in got:
        size[r.shard] += r["size"]
    groups = Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 1
    # One group holds more than an even share: it fills a shard, and the others share the rest evenly.
    total, largest = sum(groups.values()), max(groups.values())
    assert sum(size.values()) == total and largest > total / 16 and max(size.values()) == largest
    rest = sorted(size.values())[:-1]
    assert rest[-1] - rest[0] <= 25
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    where = {}
    for r in got:
        if r["size"] > 1:  # null and empty texts are groups of their own
            assert where.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
