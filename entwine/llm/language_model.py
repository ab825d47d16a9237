"""Language-model scoring with a log-bilinear neural model.

The vocabulary is every word of the training documents. The `shortlist` most
frequent words, more of them the more tokens there are, are classes of their own; the others fall into `buckets` classes
by their last letters. The neural model predicts the class of a token from the two before it:

    s(w | u, v) = (a * r[u] + b * r[v]) . q[w] + bias[w],

with vectors r, q, position weights a, b and a bias per class. It is trained in
numpy by noise-contrastive estimation against the unigram distribution, on every
training token. Documents are dealt by a hash of id and text to shards of about
`SHARD` tokens, and the shards to `ROUNDS` rounds: in each, every shard learns
from the same start, and the parameters are averaged by token count, which is
the next round's start. So the model depends on the documents alone, not on how
a table is cut into partitions. As a score is a sum of a part of u and a part of v, the
normalisers of all contexts are one product of two matrices, exp(a * r . q) and exp(b * r . q + bias), and
probabilities are exact; a word within its class has its smoothed unigram share,
beside which each bucket has one share for the words that it has not seen.

Counts of frequent words travel to every executor as a table of at most `head`
words. The others meet their counts in a join, so the count is exact for all words
and nothing that grows with the vocabulary is collected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable

#: Tokens of a shard in one round, rounds of averaging, and shards averaged by one task.
SHARD, ROUNDS, FAN = 400_000, 4, 32
#: The token after a text's last word. It holds a blank, so no word equals it.
END = " end"


def words_of(text: str | None) -> list[bytes]:
    """A text's words in UTF-8, A to Z in lower case: bytes know no other letters, and no other blanks than \\x09-\\x0D and space."""
    return (text or "").encode().lower().split()


def held_out(doc_id: str = "doc_id", remainder: int = 1) -> Column:
    """crc32 of the id as text mod 5 is `remainder`; null ids are in training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def bucket_of(word: bytes, buckets: int) -> int:
    """The class of a rare word: by its last letters, with the word's own punctuation told apart."""
    body = word.rstrip(b".,;:!?\"')")
    h = 2166136261
    for c in body[-3:]:
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return ((h >> 7) * 2 + (body != word)) % buckets


@dataclass(frozen=True)
class Shape:
    shortlist: int = 384
    buckets: int = 128
    dim: int = 16
    head: int = 150_000

    @property
    def classes(self) -> int:
        return self.shortlist + self.buckets + 1  # the last is END's

    @property
    def end(self) -> int:
        return self.shortlist + self.buckets


def shape_for(tokens: int) -> Shape:
    """The shape for that many training tokens: the shortlist grows with their root, up to the bound of a table of all contexts."""
    return Shape(shortlist=min(1920, max(384, int(tokens**0.5 / 2) // 64 * 64)))


#: A lexicon's value is class * NO_INDEX + index into the head's counts; NO_INDEX - 1 stands for none.
NO_INDEX = 1 << 24


class Lexicon(dict):
    """word -> class and index in one number; rare words are remembered up to a bound."""

    def __init__(self, head: dict[bytes, int], shape: Shape, most: int = 200_000):
        super().__init__(head)
        self.head, self.shape, self.most = head, shape, most + len(head)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.head)
        self[word] = found = (self.shape.shortlist + bucket_of(word, self.shape.buckets)) * NO_INDEX + NO_INDEX - 1
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, c) over all documents: tokens are folded words and one END per document.

    Each task counts its own words first and passes them on whenever it knows
    `flush` different ones, so its memory is bounded and frequent words hardly travel.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0):
                seen.update(words_of(text.as_py()))
                seen[END.encode()] += 1
                if len(seen) >= flush:
                    yield rows()
        if seen:
            yield rows()

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def nce_pass(params: dict[str, np.ndarray], log_noise: np.ndarray, noise_p: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, rng, state: dict[str, np.ndarray], noise: int = 24, rate: float = 0.1, cdf: np.ndarray | None = None) -> None:
    """One AdaGrad step of noise-contrastive estimation on a batch of contexts (u, v) and classes w.

    The batch shares `noise` draws from the unigram distribution; each stands for
    its part of the noise of every token. Scores count as log-probabilities, as NCE allows.
    `cdf`, the sums of `noise_p`, spares making them for each batch; the draws are the same.
    """
    r, q, a, b, bias = (params[k] for k in ("r", "q", "a", "b", "bias"))
    ru, rv = r[u], r[v]
    h = ru * a + rv * b
    k = rng.choice(len(log_noise), noise, p=noise_p) if cdf is None else cdf.searchsorted(rng.random(noise), side="right")
    shift = np.float32(np.log(noise))
    true = np.einsum("ij,ij->i", h, q[w]) + bias[w] - log_noise[w] - shift
    false = h @ q[k].T + (bias[k] - log_noise[k] - shift)
    gt = 1 / (1 + np.exp(true))  # d log-likelihood / d score of the true class
    gf = -1 / (1 + np.exp(-false))
    n = np.float32(len(w))
    gh = gt[:, None] * q[w] + gf @ q[k]
    grads = {"a": (gh * ru).sum(0), "b": (gh * rv).sum(0), "q": np.zeros_like(q), "r": np.zeros_like(r), "bias": np.bincount(w, gt, len(bias)).astype(np.float32)}
    np.add.at(grads["bias"], k, gf.sum(0))
    np.add.at(grads["q"], k, gf.T @ h)
    for name, at, rows in (("q", w, gt[:, None] * h), ("r", u, gh * a), ("r", v, gh * b)):
        order = np.argsort(at.astype(np.uint16), kind="stable")
        sorted_at = at[order]
        begin = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
        grads[name][sorted_at[begin]] += np.add.reduceat(rows[order], begin, axis=0)
    for name, g in grads.items():
        g /= n
        state[name] += g * g
        params[name] += np.float32(rate) * g / np.sqrt(state[name] + np.float32(1e-8))


def start(shape: Shape, log_unigram: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """The parameters before training: the unigram distribution, with small vectors."""
    rng = np.random.default_rng(seed)
    c, d = shape.classes, shape.dim
    small = lambda: (rng.standard_normal((c, d)) * 0.1).astype(np.float32)
    return {"r": small(), "q": small(), "a": np.ones(d, np.float32), "b": np.ones(d, np.float32), "bias": log_unigram.astype(np.float32)}


def normalisers(params: dict[str, np.ndarray]) -> np.ndarray:
    """log of the sum over classes of exp(score), for every pair (u, v): classes x classes, as one matrix product."""
    r, q, a, b, bias = (params[k].astype(np.float64) for k in ("r", "q", "a", "b", "bias"))
    first, second = (r * a) @ q.T, (r * b) @ q.T + bias
    top1, top2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
    return (np.log(np.maximum(np.exp(first - top1) @ np.exp(second - top2).T, 1e-300)) + top1 + top2.T).astype(np.float32)


@dataclass
class LanguageModel:
    """What scoring needs: bounded by the shape, but for `counts`, which stays a table."""

    shape: Shape
    counts: DataFrame
    total: int
    distinct: int
    head: dict[bytes, int]
    head_counts: np.ndarray
    log_mass: np.ndarray
    params: dict[str, np.ndarray]
    log_z: np.ndarray


def fit(docs: DataFrame, shape: Shape | None = None, batch: int = 512, id_col: str = "doc_id", shard: int = SHARD) -> LanguageModel:
    """Count all tokens of `docs` (id, text) and train the log-bilinear model on all of them.

    A null text is empty, one END token. Words with equal counts are ranked by
    their bytes. Texts of any length are read whole; repeated rows count and train
    each; other columns are ignored. Without documents every word is
    unknown; the model is then the smoothed uniform one.
    """
    counts = durable(word_counts(docs.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shape = shape or shape_for(total)
    # The head: all words counted `least` times or more, the least number (of a fixed scale) that leaves at most shape.head.
    scale = F.floor(F.log2(F.col("c").cast("double")) * 16 + 1e-9).cast("int")
    steps = {r.s: r.n for r in counts.where(F.col("word") != END).groupBy(scale.alias("s")).agg(F.count("*").alias("n")).collect()}
    least, held = max(steps, default=0) + 1, 0
    while least - 1 >= min(steps, default=1) and held + steps.get(least - 1, 0) <= shape.head:
        least -= 1
        held += steps.get(least, 0)
    common = (F.col("word") != END) & (scale >= least)
    rows = sorted(((r.word.encode(), r.c) for r in counts.where(common).collect()), key=lambda x: (-x[1], x[0]))
    end_count = next((r.c for r in counts.where(F.col("word") == END).collect()), 0)
    classes = [i if i < shape.shortlist else shape.shortlist + bucket_of(w, shape.buckets) for i, (w, _) in enumerate(rows)]
    head = {w: k * NO_INDEX + i for i, ((w, _), k) in enumerate(zip(rows, classes))}
    head_counts = np.array([c for _, c in rows], float)
    # Mass (c + 0.5) of each class: the head's here, the others' summed by Spark per class. Each bucket has an
    # unknown word besides, c = 0, so its words' shares and the unknown one's sum to 1.
    mass = np.zeros(shape.classes)
    mass[shape.shortlist : shape.end] = 0.5
    np.add.at(mass, classes, head_counts + 0.5)
    if held < distinct - (end_count > 0):
        tail = counts.where((F.col("word") != END) & ~common)

        def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k = np.array([bucket_of(w.encode(), shape.buckets) for w in b.column(0).to_pylist()], np.int64)
                m = np.bincount(k, b.column(1).to_numpy() + 0.5, shape.buckets)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape.buckets)), pa.array(m)], ["k", "m"])

        for r in tail.select("word", "c").mapInArrow(classed, "k long, m double").groupBy("k").agg(F.sum("m").alias("m")).collect():
            mass[shape.shortlist + r.k] += r.m
    mass[shape.end] = end_count + 0.5
    log_unigram = np.log(np.maximum(mass, 1e-3) / np.maximum(mass, 1e-3).sum())
    params = train(docs, shape, head, log_unigram, batch, id_col, total, shard)
    return LanguageModel(shape, counts, total, distinct, head, head_counts, np.log(np.maximum(mass, 0.5)), params, normalisers(params))


def coded(docs: DataFrame, shape: Shape, head: dict[bytes, int], id_col: str, parts: int) -> DataFrame:
    """(part, key, ids): each text's classes as 16-bit numbers; its part and its place there are hashes of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col("text").isNull(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value, shape)
        for b in batches:
            ids = [(lexicon.of(words_of(t.as_py())) // NO_INDEX).astype(np.uint16).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    rows = docs.select(key.alias("key"), "text").mapInArrow(run, "key long, ids binary")
    return durable(rows.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long").alias("part"), "key", "ids"))


def averaged(learned: DataFrame, n_shards: int, names: list[str], like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean, by tokens seen, of what shards learned (shard, seen, flat), added up in the order of the shards, FAN at a time."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        total = sum(np.frombuffer(x, np.float64) for x in pdf["flat"])
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0]) // FAN], "seen": [int(pdf["seen"].sum())], "flat": [total.tobytes()]})

    while True:
        learned = learned.groupBy(F.floor(F.col("shard") / FAN)).applyInPandas(add, "shard long, seen long, flat binary")
        n_shards = -(-n_shards // FAN)
        if n_shards <= 1:
            break
    row = learned.first()
    if row is None or not row.seen:
        return like
    flat, out, at = np.frombuffer(row.flat, np.float64) / row.seen, {}, 0
    for k in names:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(docs: DataFrame, shape: Shape, head: dict[bytes, int], log_unigram: np.ndarray, batch: int, id_col: str, tokens: int, shard: int) -> dict[str, np.ndarray]:
    """The parameters after ROUNDS rounds in which shards learn apart, each token once, and are averaged."""
    params = start(shape, log_unigram)
    n_shards = max(1, -(-tokens // (shard * ROUNDS)))
    rows = coded(docs, shape, head, id_col, ROUNDS * n_shards)
    # AdaGrad's sums of squares are averaged as well, as parameters named after theirs.
    both = params | {f"{k}/state": np.full(x.shape, 1e-6, np.float32) for k, x in params.items()}
    names = list(both)
    noise = log_unigram.astype(np.float32)
    noise_p = np.exp(log_unigram) / np.exp(log_unigram).sum()
    cdf = noise_p.cumsum()
    cdf /= cdf[-1]

    def learner(begin: dict[str, np.ndarray]):
        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "ids"])
            mine = {k: x.copy() for k, x in begin.items()}
            own, state = {k: mine[k] for k in params}, {k: mine[f"{k}/state"] for k in params}
            part, seen = int(pdf["part"].iloc[0]), 0
            rng = np.random.default_rng([11, part])
            texts, size = [], 0
            for i, ids in enumerate(pdf["ids"]):
                # Each text has two END before it and one after it.
                texts.append(np.concatenate([[shape.end, shape.end], np.frombuffer(ids, np.uint16).astype(np.int64), [shape.end]]))
                size += len(texts[-1]) - 2
                if size < 200_000 and i < len(pdf) - 1:
                    continue
                x = np.concatenate(texts)
                at = np.concatenate([np.arange(2, len(t)) + n for t, n in zip(texts, np.cumsum([0, *map(len, texts[:-1])]))])
                at = at[rng.permutation(len(at))]
                for s in range(0, len(at), batch):
                    p = at[s : s + batch]
                    nce_pass(own, noise, noise_p, x[p - 2], x[p - 1], x[p], rng, state, cdf=cdf)
                seen, texts, size = seen + size, [], 0
            flat = np.concatenate([mine[k].ravel() for k in names]).astype(np.float64) * seen
            return pd.DataFrame({"shard": [part // ROUNDS], "seen": [seen], "flat": [flat.tobytes()]})

        return learn

    for turn in range(ROUNDS):
        learned = rows.where(F.col("part") % ROUNDS == turn).groupBy("part").applyInPandas(learner(both), "shard long, seen long, flat binary")
        both = averaged(learned, n_shards, names, both)
    return {k: both[k] for k in params}


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    `base_score` is the smoothed unigram's, `score` the neural model's, both with
    exact counts of all words. Null and blank texts are one END token; texts of any
    length are scored whole. Repeated
    rows are scored as rows of their own, alike; ids of any type and null ids are kept; other columns are ignored; an empty
    table gives an empty one. Nothing is ranked, so there are no ties.
    """
    sc, shape = docs.sparkSession.sparkContext, model.shape
    head, params, log_z = sc.broadcast(model.head), sc.broadcast(model.params), sc.broadcast(model.log_z)
    c0, log_mass = model.head_counts, model.log_mass
    end_c = next((r.c for r in model.counts.where(F.col("word") == END).collect()), 0)
    denominator = float(np.log(model.total + 0.5 * (model.distinct + 1)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document, whose key matches no word, and one per rare word in it."""
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        lexicon = Lexicon(head.value, shape)
        p, z = params.value, log_z.value
        log_c = np.append(np.log(c0 + 0.5), 0.0)  # the last is for words of the join
        left, right = p["r"] * p["a"], p["r"] * p["b"]
        end_part = float(np.log(end_c + 0.5))
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("row", "word", "n", "known", "base", "score")}
            rare_words, tfs, kinds = [], [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                found = lexicon.of(words)
                row, n = (part << 40) + n, n + 1
                at = np.minimum(found % NO_INDEX, len(c0))
                x = np.concatenate([[shape.end, shape.end], found // NO_INDEX, [shape.end]])
                u, v, w = x[:-2], x[1:-1], x[2:]
                s = np.einsum("ij,ij->i", left[u] + right[v], p["q"][w]) + p["bias"][w] - z[u, v]
                word_part = float(log_c[at].sum())
                rare = np.flatnonzero(at == len(c0))
                out["row"].append(row)
                out["word"].append(b" %d" % row)
                out["n"].append(len(w))
                out["known"].append(len(at) - len(rare) + (end_c > 0))
                out["base"].append(word_part + end_part - len(w) * denominator)
                out["score"].append(float(s.sum(dtype=np.float64)) + word_part - float(log_mass[w[:-1]].sum()))
                tf = Counter(map(words.__getitem__, rare.tolist()))
                rare_words += tf.keys()
                tfs += tf.values()
                kinds.append(len(tf))
            # First the documents' rows, then those of their rare words, made at once for the batch.
            more = len(tfs)
            padded = lambda x, kind: pa.array(np.concatenate([np.array(x, kind), np.zeros(more, kind)]))
            at_row = np.array(out["row"], np.int64)
            ids = pa.concat_arrays([b.column(0), pa.nulls(more, b.column(0).type)])
            tf = pa.array(np.concatenate([np.zeros(len(at_row), np.int64), np.array(tfs, np.int64)]))
            spelled = pa.array(out["word"] + rare_words, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([at_row, np.repeat(at_row, np.array(kinds, np.int64))])), spelled, ids, tf, padded(out["n"], np.int64), padded(out["known"], np.int64), padded(out["base"], np.float64), padded(out["score"], np.float64)],
                ["row", "word", "id", "tf", "n", "known", "base", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, "text").mapInArrow(local, f"row long, word string, id {kind}, tf long, n long, known long, base double, score double")
    counts = model.counts.select(F.col("word").alias("_word"), "c")
    met = rows.join(counts, F.col("word") == F.col("_word"), "left")
    add = F.col("tf") * F.log(F.coalesce("c", F.lit(0)) + 0.5)
    known = F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)
    summed = met.groupBy("row").agg(F.max("id").alias(id_col), F.sum("n").alias("n_tokens"), F.sum(F.col("known") + known).alias("n_known"), F.sum(F.col("base") + add).alias("base"), F.sum(F.col("score") + add).alias("score"))
    to10 = float(np.log(10.0))
    return summed.select(id_col, "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("base") / to10).alias("base_score"), (F.col("score") / to10).alias("score"))
