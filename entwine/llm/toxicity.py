"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence has the probability
p = sigmoid(bias + sum of the weights of its words and word beginnings), and the
document's is the noisy-or 1 - prod(1 - p). Only documents have labels; the
likelihood of the noisy-or teaches which sentences carry them, so the fitted
weights also locate the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import durable

#: A sentence ends at a line end or at one of .!?; its words are runs of letters, digits, marks.
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features besides whole words.
STEMS = (4, 6)


def features(word: str) -> tuple[str, ...]:
    """A word's features: itself, and its first letters with a mark."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature; a sentence without any has the logit `bias`."""

    bias: float
    weights: dict[str, float]

    def word_weights(self) -> WordWeights:
        return WordWeights(self.weights)


class WordWeights(dict):
    """word -> the sum of its features' weights; remembers at most `most` words."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = sum(self.weights.get(f, 0.0) for f in features(word))
        return value


def labelled(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """Up to `max_docs` labelled rows (doc_id, text, y), picked by a hash of the id.

    The sample of labels is at most `max_docs` rows of two numbers, so sending
    it to every executor has a fixed bound and the documents are not shuffled.
    Labels that are null don't count; a document with several has the largest.
    """
    picked = (
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_features: int = 6000, min_docs: int = 4, rounds: int = 300, l1: float = 2.5e-4, l2: float = 1e-4) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows (`max_docs`), as the bounds allow.

    The `max_features` features that differ most between the classes are chosen
    by a count over the sample in Spark (ties by name); each document then becomes the distinct
    sets of chosen features in its sentences, with how often each occurs, so what
    reaches the driver is bounded by the sample and the features. Without a row
    of both classes, so in an empty table as well, the model is the constant share of toxic rows.
    Null texts are empty; texts of any length count whole; rows that repeat a labelled id
    count each; columns other than doc_id and text are ignored.

    `max_features` and `min_docs` bound the model, not the rows: features in
    fewer documents than `min_docs`, and those that tell the classes apart least, have no weight.
    """
    sample = durable(labelled(docs, labels, max_docs))
    schema = "y int, present array<string>"

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({f for w in set(WORD.findall((t or "").lower())) for f in features(w)}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.string()))], ["y", "present"])

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sum(n for y, n in sizes.items() if y > 0), sizes.get(0, 0)
    if not n1 or not n0:
        p = min(max(n1 / max(1, n1 + n0), 1e-4), 1 - 1e-4)
        return ToxicityModel(float(np.log(p / (1 - p))), {})
    a = F.col("tox") / n1
    b = F.col("clean") / n0
    counted = (
        sample.select("text", "y").mapInArrow(present, schema).select("y", F.explode("present").alias("f")).groupBy("f")
        .agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("tox"), F.sum(F.when(F.col("y") > 0, 0).otherwise(1)).alias("clean"))
        .where(F.col("tox") + F.col("clean") >= min_docs)
        .withColumn("gap", (a - b) * (a - b) / (a + b))
    )
    names = [r.f for r in counted.orderBy(F.desc("gap"), "f").limit(max_features).select("f").collect()]
    index = {f: i for i, f in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                seen: dict[tuple[int, ...], int] = {}
                for s in SENTENCE.findall((t or "").lower()) or [""]:
                    k = tuple(sorted({i for w in set(WORD.findall(s)) for f in features(w) if (i := index.get(f)) is not None}))
                    seen[k] = seen.get(k, 0) + 1
                flat = []
                for k, n in seen.items():
                    flat += [n, len(k), *k]
                out.append(np.array(flat, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(out, pa.binary())], ["y", "bag"])

    y, times, doc_of, rows, cols = [], [], [], [], []
    for d, r in enumerate(sample.select("text", "y").mapInArrow(bags, "y int, bag binary").toLocalIterator()):
        y.append(min(r.y, 1))
        flat, at = np.frombuffer(r.bag, np.int32), 0
        while at < len(flat):
            n, k = int(flat[at]), int(flat[at + 1])
            rows += [len(times)] * k
            cols += flat[at + 2 : at + 2 + k].tolist()
            times.append(n)
            doc_of.append(d)
            at += 2 + k
    w, bias = noisy_or_fit(np.array(y), np.array(doc_of), np.array(times, float), np.array(rows, np.int64), np.array(cols, np.int64), len(names), rounds, l1, l2)
    return ToxicityModel(bias, {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3})


def noisy_or_fit(y, doc_of, times, rows, cols, n_features: int, rounds: int, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Adam on the mean log-likelihood of the noisy-or, with weights that cross or can't leave zero held there.

    Sentence row s belongs to document `doc_of[s]` and occurs `times[s]` times.
    """
    n_docs, n_rows = len(y), len(times)
    w, bias = np.zeros(n_features), -6.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    order = np.argsort(doc_of, kind="stable")
    assert (order == np.arange(n_rows)).all()
    for step in range(1, rounds + 1):
        z = bias + np.bincount(rows, w[cols], n_rows)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        keep = np.bincount(doc_of, -times * np.logaddexp(0, np.clip(z, -30, 30)), n_docs)  # log prod(1 - p)
        keep = np.minimum(keep, -1e-12)
        pull = np.where(y > 0, np.exp(keep) / -np.expm1(keep), -1.0)
        dz = pull[doc_of] * p * times / n_docs
        g = np.append(np.bincount(cols, dz[rows], n_features) - l2 * w - l1 * np.sign(w), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        new, bias = w + move[:-1], bias + move[-1]
        w = np.where((w == 0) & (np.abs(g[:-1]) <= l1) | (new * w < 0), 0.0, new)
    return w, float(bias)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text", spans: bool = True) -> DataFrame:
    """Add score (double, 0 to 1), predicted (int) and, with `spans`, offending: [{start, end, p}].

    `start` and `end` count code points of the whole text; a sentence is
    offending if its own probability is at least `threshold`. Null and empty
    texts have one empty sentence, so the score of the bias alone; texts of any
    length are scored whole; a score of `threshold` exactly is toxic; repeated rows are scored
    one by one, alike; an empty table gives an empty one. Columns that
    `docs` has under the new names are replaced; the pipeline gives its columns other names first.
    """
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias
    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if spans:
        extra.append(T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))))
    kept = [f for f in docs.schema.fields if f.name not in {e.name for e in extra}]
    names = [f.name for f in kept]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = WordWeights(weights.value)
        base = float(np.logaddexp(0, bias))  # -log(1 - p) of a sentence without features
        floor = log(threshold / (1 - threshold))
        for b in batches:
            scores, found = [], []
            for text in b.column(at):
                text = (text.as_py() or "")
                low = text.lower()
                clean, hits, n = 0.0, [], 0  # clean: -log of the chance that no sentence is toxic
                for s in SENTENCE.finditer(low):
                    n += 1
                    z = bias + sum(map(word.__getitem__, WORD.findall(s[0])))
                    if z == bias:
                        clean += base
                        continue
                    clean += z if z > 30 else log1p(exp(z))
                    if z >= floor:
                        hits.append((s.start(), s.end(), 1 / (1 + exp(-min(z, 30.0)))))
                clean = clean if n else base
                scores.append(-float(np.expm1(-clean)))
                if spans and hits and len(low) != len(text):  # lower() changed lengths: find the spans by lengths of lowered prefixes
                    ends = np.cumsum([len(c.lower()) for c in text])
                    hits = [(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, e - 1, "right")) + 1, p) for a, e, p in hits]
                found.append([{"start": a, "end": e, "p": p} for a, e, p in hits])
            columns = [*b.columns, pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, [*names, *(e.name for e in extra)])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, T.StructType([*kept, *extra]))


def held_out(doc_id: str = "doc_id", remainder: int = 0) -> F.Column:
    """crc32 of the id as text mod 5 is `remainder`; ids that are null are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "toxic").where(~held_out())
