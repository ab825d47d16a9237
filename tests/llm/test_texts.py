"""Operators on documents: each against a plain version, on awkward rows and on none."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entwine.llm import bpe, language_model, mixing, ngram_join, quality, sharding, toxicity
from entwine.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, k1 string, _w int, size string, row_id int, c double, score string, `a b` int"


def rows():
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma.", "Delta", "über", "中文", "x"]) + str(rng.randrange(300)) for _ in range(n))
    long = make(30_000)
    base = [make(120) for _ in range(12)]
    near = base[0].split()
    near[60] = "changed"
    texts = [*base, " ".join(near), base[1], base[1], None, "", " \t\n", "one two", "one  two", "x" * 5000, long, long + " more", "same line\nsame line\n" * 40, "### $$$ %% " * 60, "A b c.\n" * 3, "word " * 80]
    out = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "", "s2", "s1", "s1"][i % 6]) for i, t in enumerate(texts)]
    out += [out[2], out[15], out[16]]  # repeated rows, with null and empty text among them
    return [(*r, None, "k", i, "s", None, 1.5, "sc", i) for i, r in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def words(t):
    return WORD.findall(t or "")


def test_bpe_equals_the_library_and_decodes(spark, docs, none):
    ranks, pattern = tokenizer()
    enc, _ = bpe.load_encoding(ranks, pattern)
    want = Counter()
    for r in rows():
        ids = enc.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    got = bpe.encode_decode(docs, ranks, pattern, leaf_chars=64)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    back = bpe.decode(got, ranks, pattern).select("doc_id", "decoded").collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == Counter((r[0], r[1] or "") for r in rows())
    assert bpe.encode_decode(none, ranks, pattern).count() == 0


def test_bpe_tree_on_random_strings():
    ranks, pattern = tokenizer()
    enc, pieces = bpe.load_encoding(ranks, pattern)
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "'s", "'", "22", "!", "é", "中", "\U0001F600", "\x1c", "\x85", " the", "ll"]
    for leaf in (1, 2, 7):
        codec = bpe.TreeCodec(enc.encode_ordinary, pieces, leaf)
        for _ in range(400):
            s = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
            ids = codec.encode(s)
            assert ids == enc.encode_ordinary(s) and codec.decode(ids) == s.encode()


def plain_counts(t):
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_and_verdicts(spark, docs, none):
    got = quality.assess(docs, min_rows=3).collect()
    want = Counter((r[0], *plain_counts(r[1])) for r in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed)
    kept = quality.keep_good(docs, min_rows=3)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.assess(none).count() == 0 and quality.keep_good(none).count() == 0


def test_quality_fences_follow_the_group(spark):
    plain = " ".join(f"w{i}" for i in range(60))
    odd = plain + " ###" * 40
    data = [(i, plain + f" {i}", "en", "a") for i in range(40)] + [(100, odd, "en", "a")] + [(200 + i, odd + f" {i}", "en", "b") for i in range(40)]
    got = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), min_rows=10).collect()}
    assert not got[100] and got[0] and got[200]  # the same text is usual in source b


def jaccard_truth(data):
    sets = []
    for r in data:
        w = words(r[1])
        sets.append(({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())) if r[0] is not None else set())
    n, parent = Counter(), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(data):
        k = find(i)
        least[k] = min(least.get(k, r[0]), r[0])
    return Counter((r[0], n[i], least[find(i)]) for i, r in enumerate(data))


@pytest.mark.parametrize("block", [1024, 2])
def test_ngram_join_equals_all_pairs(spark, docs, none, block):
    got = ngram_join.jaccard_join(docs, block=block, shingles=1_000_000 if block > 2 else 300).collect()
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got) == jaccard_truth(rows())
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert ngram_join.jaccard_join(none).count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    left = ngram_join.first_of_each_class(docs)
    ids = Counter(r.doc_id for r in left.collect())
    assert left.columns == docs.columns
    assert ids[0] == 1 and 12 not in ids and ids[1] == 1 and 13 not in ids and 14 not in ids and ids[2] == 1
    assert all(ids[i] for i in (15, 16, 17))  # null, empty and blank texts have no similar ones


def test_banding_reaches_its_recall():
    bands, rows_ = ngram_join.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.9995


def test_mix_follows_targets(spark, docs, none):
    out, pieces = mixing.mix(docs, block=50)
    got = out.collect()
    data = rows()
    size = Counter()
    for r in data:
        size[r[3]] += len(words(r[1]))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in data)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, opened = 1.5 * sum(size.values()), set(names)
    while True:
        level = (total - sum(2 * size[s] for s in names if s not in opened)) / sum(weight[s] for s in opened)
        over = {s for s in opened if level * weight[s] > 2 * size[s]}
        if not over:
            break
        opened -= over
    target = {s: level * weight[s] if s in opened else 2 * size[s] for s in names}
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    per = pieces.groupBy("source_no", "slot").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in per) <= 100  # a source's blocks are equal; with few of them they stray from the wanted length
    again = mixing.mix(docs.repartition(5), block=50)[0].collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(none)[0].count() == 0
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs, block=50).collect())
    assert max(copies.values()) <= 4 and sum(copies.values()) == sum(r.starts for r in got)


def test_early_slots_mix_like_late_ones(spark):
    data = [(i, "a b c d e f g h i j", "en", "abc"[i % 3]) for i in range(600)]
    _, pieces = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), block=20)
    first = pieces.where("slot < 100").groupBy("source_no").agg(F.sum("length").alias("n")).collect()
    total = sum(r.n for r in first)
    share = {1: 4000 / 9000, 2: 5000 / 3 / 9000, 3: 10000 / 3 / 9000}  # the first source stops at twice its size
    assert len(first) == 3 and all(abs(r.n / total - share[r.source_no]) < 0.03 for r in first)


@pytest.mark.parametrize("chunk", [4096, 4])
def test_shards_are_even_and_keep_groups(spark, docs, none, chunk):
    got = sharding.shard_by_bytes(docs, shards=4, chunk=chunk).collect()
    data = rows()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    where = {}
    texts = {r[0]: r[1] for r in data}
    for r in got:
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(none).count() == 0


def test_differencing_is_tight():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 5000) for _ in range(3000)]
    own, sums = sharding.difference([[s] for s in sizes], 16)
    check = Counter()
    for s, (shard,) in zip(sizes, own):
        check[shard] += s
    assert [check[i] for i in range(16)] == sums and max(sums) - min(sums) <= 20
    left, right = sharding.difference([[5, 4], [3, 1]], 2)
    assert right == [7, 6] or right == [8, 5] or sum(right) == 13
    assert sharding.difference([], 3) == ([], [0, 0, 0])


def test_toxicity_learns_sentences_from_documents(spark, docs, none):
    rng = random.Random(1)
    clean = [f"{rng.choice('abcdefgh')}word{rng.randrange(40)}" for _ in range(400)]
    data, labels = [], []
    for i in range(300):
        sentences = [" ".join(rng.choice(clean) for _ in range(8)) for _ in range(5)]
        if bad := i % 4 == 0:
            sentences[2] = sentences[2] + " nasty" + rng.choice(["ly", "ness", ""])
        data.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    table, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, toxicity.training_labels(marks))
    got = toxicity.score(table, model).collect()
    truth = dict(labels)
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 295
    text = dict(data)
    found = [text[r.doc_id][s.start : s.end] for r in got if truth[r.doc_id] for s in r.offending]
    assert found and sum("nasty" in f for f in found) >= 0.9 * len(found)
    odd = toxicity.score(docs, model, spans=False)
    assert odd.count() == len(rows()) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    alone = toxicity.fit(table, marks.where("toxic = 0"))
    assert not alone.weights and toxicity.fit(none, marks).weights == {}


def test_spans_count_characters_of_the_text(spark):
    model = toxicity.ToxicityModel(-5.0, {"bad": 9.0})
    t = "İstanbul İİ ok. very bad here! fine"
    (r,) = toxicity.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).collect()
    assert [t[s.start : s.end] for s in r.offending] == [" very bad here"]


def test_language_model_base_is_exact_and_probabilities_sum_to_one(spark, docs, none):
    import math

    import numpy as np

    train = docs.where(~language_model.held_out())
    shape = language_model.Shape(shortlist=8, buckets=4, dim=4, head=20)
    model = language_model.fit(train, shape)
    count = Counter()
    data = rows()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    low = lambda t: [w.encode().lower().decode() for w in words(t)]
    for r in data:
        if not held(r[0]):
            count.update([*low(r[1]), None])
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for r in data:
        ws = [*low(r[1]), None]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        want[(r[0], len(ws), sum(count[w] > 0 for w in ws), round(base, 5))] += 1
    got = language_model.score(docs, model).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    p, z = model.params, model.log_z
    for u, v in ((0, 1), (shape.end, shape.end), (9, 3)):
        s = (p["r"][u] * p["a"] + p["r"][v] * p["b"]) @ p["q"].T + p["bias"]
        assert abs(np.exp(s - z[u, v]).sum() - 1) < 1e-4
    empty = language_model.fit(none, shape)
    assert language_model.score(none, empty).count() == 0 and language_model.score(docs, empty).count() == len(data)


def test_language_model_learns_context(spark):
    data = [(i, " ".join(["red fox" if (i + j) % 2 else "blue jay" for j in range(40)])) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = language_model.fit(docs, language_model.Shape(shortlist=8, buckets=4, dim=8))
    got = language_model.score(docs, model).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
