"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one, so cosine >= c is a distance <= sqrt(2 - 2c).
A table hashes a vector by k quantised Gaussian projections floor((a.x + b) / w);
the number of tables follows from the wanted recall at that distance. Buckets
first meet without the vectors, as rows of a name and a sketch of 192 signs, whose
Hamming distance rules out nearly all unrelated pairs. Only vectors with a
neighbour left in a bucket travel there and are compared, block by block, by
matrix products in double precision, which decide alone;
a pair counts in the first table that brings it together. Equal vectors are one
node with a count, and tasks return counts and edges to a root, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import connected_components, durable, local_roots, mix64

#: Rows of a block in a bucket's comparison, and rows that small buckets bring together in one task.
BLOCK, TASK = 2048, 4096
#: Signs of a sketch.
SIGNS = 192


def collision(distance: float, width: float) -> float:
    """The chance that a quantised Gaussian projection of that width puts two vectors in one cell."""
    if distance <= 0:
        return 1.0
    c = width / distance
    return erf(c / sqrt(2)) - 2 / (sqrt(2 * pi) * c) * (1 - exp(-c * c / 2))


@dataclass(frozen=True)
class Hashing:
    """`tables` tables of `k` projections with cells of `width`."""

    tables: int
    k: int
    width: float = 2.0
    seed: int = 20

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(n, tables) bucket numbers of the rows of x."""
        dim = x.shape[1]
        rng = np.random.default_rng([self.seed, dim])
        a, b = rng.standard_normal((dim, self.tables * self.k)), rng.random(self.tables * self.k) * self.width
        cells = np.floor((x @ a + b) / self.width).astype(np.int64).view(np.uint64).reshape(len(x), self.tables, self.k)
        with np.errstate(over="ignore"):
            h = np.full((len(x), self.tables), dim, np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for i in range(self.k):
                h = mix64(h ^ cells[:, :, i])
        return h.view(np.int64)


def plan(n: int, threshold: float, recall: float, width: float = 2.0, bucket: int = 1024) -> Hashing:
    """The hashing for n vectors: enough projections that about `bucket` unrelated ones share a cell, enough tables for the recall.

    k grows with log n, so the sketches compared per vector and table do not grow with n.
    """
    far, near = collision(sqrt(2.0), width), collision(sqrt(max(0.0, 2 - 2 * threshold)), width)
    k = max(4, ceil(log(max(n, 1) / bucket) / -log(far)))
    p = near**k
    return Hashing(1 if p >= 1 else max(1, ceil(log(1 - recall) / log(1 - p))), k, width)


def most_signs(threshold: float, sigmas: float = 4.5) -> int:
    """The Hamming distance that sketches at the threshold exceed with a chance under 1e-5: the mean and `sigmas` deviations."""
    p = acos(max(-1.0, min(1.0, threshold))) / pi
    return min(SIGNS, ceil(SIGNS * p + sigmas * sqrt(SIGNS * p * (1 - p))))


def sketch(x: np.ndarray, seed: int = 41) -> np.ndarray:
    """(n, SIGNS / 64) words of signs of random projections of the rows of x."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _segments(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per bucket and pair of blocks in a sorted frame: its first row, and the row numbers of its two sides (the same ones within a block)."""
    h, lo, hi, own = (pdf[c].to_numpy() for c in ("h", "lo", "hi", "own"))
    edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
    for s, e in zip(edge[:-1], edge[1:]):
        if e - s > 1:
            at = np.arange(s, e)
            yield s, *((at, at) if lo[s] == hi[s] else (at[own[s:e] == lo[s]], at[own[s:e] == hi[s]]))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, block: int = BLOCK, hashing: Hashing | None = None) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    `n_links` counts the other rows with cosine >= `threshold`, `component_id`
    is the smallest vec_id reachable by such links. A pair at the threshold
    exactly is a link, if the tables bring it together: with a chance of `recall`,
    which grows fast with the cosine. Vectors that are null, empty,
    zero or have null or non-finite components link with nothing, nor do rows
    without a vec_id or vectors of different lengths. Repeated rows are rows of
    their own and link with each other. Other columns are ignored, whatever their names; an empty
    table gives an empty one.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.col("vec_id").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    bare = F.transform(x, lambda v: v + F.lit(0.0))  # -0.0 + 0.0 is 0.0
    keys = [F.when(fine, F.xxhash64(F.lit(seed), F.size("embedding"), bare)) for seed in (1, 9)]
    rows = vectors.select("vec_id", "embedding", keys[0].alias("k1"), keys[1].alias("k2"))
    hashing = hashing or plan(rows.count(), threshold, recall)
    nodes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("embedding").alias("x"))
    # A node's name: one id may have several vectors, so the id is not it.
    nodes = nodes.select(F.xxhash64("k1", "k2").alias("node"), "k1", "k2", "id", "w", "x")
    words = [f"s{i}" for i in range(SIGNS // 64)]
    schema = T.StructType([*nodes.schema.fields, *(T.StructField(c, T.LongType()) for c in words), T.StructField("h", T.ArrayType(T.LongType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(np.concatenate([[0], ends]))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                m = _unit(flat[(ends[at] - d)[:, None] + np.arange(d)])
                signs, h = sketch(m), hashing.buckets(m)
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * hashing.tables), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, *(pa.array(signs[:, i].copy()) for i in range(len(words))), found], [*batch.schema.names, *words, "h"])

    nodes = durable(nodes.mapInArrow(hashed, schema))
    # Buckets of more than a block are cut into pairs of blocks; the others share tasks of about TASK rows.
    flat = nodes.select("node", *words, F.explode("h").alias("h"))
    large = durable(flat.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > block).select(F.col("h").alias("_h"), F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    bins = max(1, nodes.count() * hashing.tables // TASK)

    def dealt(df: DataFrame) -> DataFrame:
        task = F.when((F.col("lo") == 0) & (F.col("hi") == 0) & (F.col("blocks") == 1), F.pmod(F.xxhash64("h"), F.lit(bins))).otherwise(F.xxhash64("h", "lo", "hi"))
        return df.withColumn("task", task)

    cut = flat.join(large, F.col("h") == F.col("_h"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", "h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select("node", *words, "h", "blocks", "own", "lo", "hi")
    most = most_signs(threshold)

    def plausible(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows with another one in their bucket whose sketch is near enough."""
        pdf = pdf.sort_values(["h", "lo", "hi", "node"], ignore_index=True)
        signs, some = [pdf[c].to_numpy().view(np.uint64) for c in words], np.zeros(len(pdf), bool)
        for _, a, b in _segments(pdf):
            for start in range(0, len(a), 512):
                r = a[start : start + 512]
                near = sum(np.bitwise_count(w[r][:, None] ^ w[b][None, :]) for w in signs) <= most
                if a is b:
                    near[np.arange(len(r)), start + np.arange(len(r))] = False
                some[r] |= near.any(axis=1)
                some[b] |= near.any(axis=0)
        return pdf.loc[some, ["node", "h", "blocks", "own", "lo", "hi"]]

    wanted = durable(dealt(cut).groupBy("task").applyInPandas(plausible, "node long, h long, blocks int, own int, lo int, hi int"))
    wanted = wanted.groupBy("node").agg(F.collect_list(F.struct("h", "blocks", "own", "lo", "hi")).alias("in")).withColumnRenamed("node", "_n")
    # The names of all its tables go with a vector, in 32 bits each, so that a pair counts once; nothing is hashed again.
    names = F.transform("h", lambda v: v.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    placed = nodes.select("node", "w", "x", names.alias("names"), F.col("h").alias("all")).join(wanted, F.col("node") == F.col("_n")).select("node", "w", "x", "names", "all", F.inline("in"))
    placed = placed.select("node", "w", "x", "names", (F.array_position("all", F.col("h")) - 1).cast("int").alias("t"), "h", "blocks", "own", "lo", "hi")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "lo", "hi", "node"], ignore_index=True)
        node, w, t = pdf["node"].to_numpy(np.int64), pdf["w"].to_numpy(np.float64), pdf["t"].to_numpy()
        size = pdf["x"].map(len).to_numpy()
        names = np.stack(pdf["names"].to_numpy())
        links, li, lj = np.zeros(len(pdf)), [], []
        for s, a, b in _segments(pdf):
            if not (size[a[0]] == size[a]).all() or not (size[a[0]] == size[b]).all():
                raise RuntimeError("vectors of different lengths share a bucket's 64-bit name")
            m = _unit(np.stack(pdf["x"].to_numpy()[b]).astype(np.float64))
            left = m if a is b else _unit(np.stack(pdf["x"].to_numpy()[a]).astype(np.float64))
            for start in range(0, len(a), 512):
                i, j = np.nonzero(left[start : start + 512] @ m.T >= threshold)
                i, j = a[start + i], b[j]
                if a is b:
                    i, j = i[i < j], j[i < j]
                for c in range(0, len(i), 1 << 18):
                    p, q = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
                    before = np.zeros(len(p), bool)
                    for e in range(t[s]):
                        before |= names[p, e] == names[q, e]
                    p, q = p[~before], q[~before]
                    links += np.bincount(p, w[q], len(pdf)) + np.bincount(q, w[p], len(pdf))
                    if len(p):  # a forest says as much as the pairs
                        used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
                        root = local_roots(at[: len(p)], at[len(p) :], len(used))
                        moved = np.flatnonzero(root != np.arange(len(used)))
                        li.append(node[used[moved]])
                        lj.append(node[used[root[moved]]])
        some = np.flatnonzero(links > 0)
        none = np.zeros(0, np.int64)
        total = pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64)}).groupby("node", as_index=False)["links"].sum()
        edges = pd.DataFrame({"node": np.concatenate([none, *li]), "root": np.concatenate([none, *lj])}).drop_duplicates()
        return pd.concat([total.assign(root=total["node"]), edges.assign(links=0)])[["node", "links", "root"]]

    found = durable(dealt(placed).groupBy("task").applyInPandas(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "_n")
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "_c")
    named = nodes.select("k1", "k2", "id", "w", "node").join(links, F.col("node") == F.col("_n"), "left").join(components, F.col("node") == F.col("_c"), "left")
    named = durable(named.select("k1", "k2", "id", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    first = named.groupBy("component").agg(F.min("id").alias("component_id")).withColumnRenamed("component", "_component")
    known = named.join(first, F.col("component") == F.col("_component")).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "component_id", (F.col("links") + F.col("w") - 1).alias("n_links"))
    out = rows.select("vec_id", "k1", "k2").join(known, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.cast("long").alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
