"""N-gram Jaccard join by MinHash banding.

A document is the set of its word five-grams. Each gets rows * bands minima of
hashed shingles; bands of equal minima bring candidates together. Candidates are
then verified on their full shingle sets, block by block:

1. Texts with the same words become one representative with a count.
2. Band hashes are shuffled without sets. Texts that share a bucket are compared
   there by a sketch, one bit of each minimum, and by their numbers of shingles;
   a bucket returns a forest of the pairs that may be similar, so texts that share
   a passage, and with it a band, are not linked for that.
3. Members' shingle sets are moved once, to the tasks of their cluster of such links. Clusters of
   more than `BLOCK` documents, or `SHINGLES` shingles, are cut into blocks by
   hash, and every pair of blocks is a task of its own.
4. A task compares the pairs that share a band and returns, per document, how
   many documents it is similar to, and one edge to its component: never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import connected_components, disguised, durable, local_roots, mix64

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9995
BLOCK, SHINGLES = 1024, 1_000_000
#: Rows of a block in a band's bucket, and rows that small buckets bring together in one task: rows of numbers, not of texts.
BUCKET, TASK = 8192, 65536
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective banding with that recall at the threshold and at most `most` minima in all."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= min(most, 128):
            best = (bands, rows)
    return best


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number mod 2^64 and of its inverse."""
    base, inverse = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, U)), np.cumprod(np.full(n, inverse, U))


def shingle_hashes(texts: list[str], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all word n-grams, their text's number, two 64-bit keys of each text's words).

    Texts are hashed as one array of bytes: a word's hash is the polynomial of
    its bytes, from differences of one running sum. A text with fewer than n
    words, but one at least, has one shingle, of all its words.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    power, inverse = _powers(1 << int(np.ceil(np.log2(max(len(data), 2)))))
    with np.errstate(over="ignore"):
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(1)) * power[: len(data)])])
        word = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * ODD)
        stops = np.cumsum([len(r) + 1 for r in raw])
        of = np.searchsorted(stops, starts, "right")
        per = np.bincount(of, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(per)])
        place = np.arange(len(word)) - first[of]
        keys = []
        for salt in (1, 2):
            x = mix64(word + mix64(place.astype(U) + U(salt << 40)))
            run = np.concatenate([[U(0)], np.cumsum(x)])
            keys.append((run[first[1:]] - run[first[:-1]] + per.astype(U)).view(np.int64))
        scaled = [mix64(word + U(k) * ODD) for k in range(min(n, 64))]
        m = len(word) - n + 1
        grams = sum((scaled[k][k : m + k] for k in range(n)), np.zeros(max(m, 0), U)) if m > 0 else np.zeros(0, U)
        whole = of[: max(m, 0)] == of[n - 1 :] if m > 0 else np.zeros(0, bool)
        grams, at = mix64(grams[whole]), of[: max(m, 0)][whole]
        short = np.flatnonzero((per > 0) & (per < n))
        if len(short):
            lone = mix64(keys[0][short].view(U) ^ ODD)
            grams, at = np.concatenate([grams, lone]), np.concatenate([at, short])
            order = np.argsort(at, kind="stable")
            grams, at = grams[order], at[order]
    return grams, at, keys[0], keys[1]


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with about `most` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, texts[start:]


def minhash(grams: np.ndarray, at: np.ndarray, n_texts: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_texts, bands) band hashes and (n_texts, words) sketches, a bit of each minimum; rows of texts without shingles are meaningless."""
    out, bits = np.zeros((n_texts, bands), U), np.zeros((n_texts, -(-bands * rows // 64) * 64), bool)
    if len(grams):
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        who = at[begin]
        seeds = mix64(np.arange(1, 2 * bands * rows + 1, dtype=U) * ODD)
        with np.errstate(over="ignore"):
            for b in range(bands):
                h = np.zeros(len(begin), U)
                for r in range(rows):
                    k = 2 * (b * rows + r)
                    x = (grams ^ seeds[k]) * (seeds[k + 1] | U(1))
                    x ^= x >> U(32)
                    least = np.minimum.reduceat(x * ODD, begin)
                    h = mix64(h + least)
                    bits[who, b * rows + r] = mix64(least) & U(1)
                out[who, b] = h
    return out.view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def most_bits(n: int, threshold: float, sigmas: float = 4.5) -> int:
    """How many of n bits may differ: those of a pair at the threshold do with a chance of (1 - threshold) / 2 each."""
    p = (1 - threshold) / 2
    return int(np.ceil(n * p + sigmas * np.sqrt(n * p * (1 - p))))


def signatures(docs: DataFrame, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, n_shingles, bands, bits) of each row; n_shingles counts distinct ones and is 0 for null and blank texts."""
    schema = "id long, k1 long, k2 long, n_shingles long, bands array<long>, bits array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, part in chunks(texts):
                grams, at, k1, k2 = shingle_hashes(part)
                sig, bits = minhash(grams, at, len(part), bands, rows)
                order = np.lexsort((grams, at))
                g, a = grams[order], at[order]
                new = np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1])]) if len(g) else np.zeros(0, bool)
                count = np.bincount(a[new], minlength=len(part))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in (sig, bits)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(part)).cast(pa.int64()), pa.array(k1), pa.array(k2), pa.array(count.astype(np.int64)), *lists], ["id", "k1", "k2", "n_shingles", "bands", "bits"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def shingle_sets(members: DataFrame) -> DataFrame:
    """Replace (k1, k2, text) by `grams`, the sorted distinct hashes, for rows whose text has these keys."""
    keep = [f for f in members.schema.fields if f.name not in ("k1", "k2", "text")]
    names = [f.name for f in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want1, want2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            texts, rest = [t or "" for t in batch.column("text").to_pylist()], batch.select(names)
            for start, part in chunks(texts):
                grams, at, k1, k2 = shingle_hashes(part)
                cut = np.searchsorted(at, np.arange(len(part) + 1))
                right = (k1 == want1[start : start + len(part)]) & (k2 == want2[start : start + len(part)])
                sets = [np.unique(grams[cut[i] : cut[i + 1]]).tobytes() for i in range(len(part)) if right[i]]
                if sets:
                    kept = rest.slice(start, len(part)).filter(pa.array(right))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], [*names, "grams"])

    return members.select(*names, "k1", "k2", "text").mapInArrow(run, schema)


def similar_pairs(sets: list[np.ndarray], bands: np.ndarray, pairs_of: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of each (rows, columns) block that share a band and have Jaccard >= threshold.

    A block's intersections come from products of 0/1 matrices over columns of
    shingles when it has many candidates, and from sorted sets when it has few.
    """
    left, right = [], []
    sizes = np.array([len(s) for s in sets], np.int64)
    for rows, cols in pairs_of:
        share = np.zeros((len(rows), len(cols)), bool)
        for b in range(bands.shape[1]):
            share |= bands[rows, b][:, None] == bands[cols, b][None, :]
        lo, hi = np.minimum(sizes[rows][:, None], sizes[cols][None, :]), np.maximum(sizes[rows][:, None], sizes[cols][None, :])
        share &= (rows[:, None] < cols[None, :]) & (lo >= threshold * hi)
        i, j = np.nonzero(share)
        if not len(i):
            continue
        if len(i) <= 4 * (len(rows) + len(cols)):
            both = np.array([len(np.intersect1d(sets[rows[a]], sets[cols[b]], assume_unique=True)) for a, b in zip(i, j)])
        else:
            both = _products(sets, rows, cols)[i, j]
        a, b = rows[i], cols[j]
        good = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
        left.append(a[good])
        right.append(b[good])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _products(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets[rows] and sets[cols]."""
    used = np.union1d(rows, cols)
    where = np.full(len(sets), -1)
    where[used] = np.arange(len(used))
    values, column, df = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    shared = df[column] > 1
    column, who = column[shared], who[shared]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(used), width), np.float32)
        m[who[a:b], column[a:b] - start] = 1
        out += m[where[rows]] @ m[where[cols]].T
    return out.astype(np.int64)


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root): per task and document with similar ones, their number (with copies) and an edge."""
    schema = "id long, links long, root long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["cluster", "lo", "hi", "id"])
        pdf = pdf.sort_values(["cluster", "lo", "hi", "id"])
        ids, weight = pdf["id"].to_numpy(np.int64), pdf["w"].to_numpy(np.float64)
        sets = [np.frombuffer(g, U) for g in pdf["grams"]]
        bands = np.array(pdf["bands"].tolist(), np.int64).reshape(len(pdf), -1)
        blocks, (lo, hi, own) = [], (pdf[c].to_numpy() for c in ("lo", "hi", "block"))
        cluster = pdf["cluster"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            here = np.arange(a, b)
            if lo[a] == hi[a]:
                blocks.append((here, here))
            else:  # every pair across, each once, whichever id is smaller
                x, y = here[own[a:b] == lo[a]], here[own[a:b] == hi[a]]
                blocks += [(x, y), (y, x)]
        i, j = similar_pairs(sets, bands, blocks, threshold)
        n = len(ids)
        links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
        root = local_roots(i, j, n) if len(i) else np.arange(n)
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]})

    return members.groupBy("task").applyInPandas(run, schema)


def forest(words: list[np.ndarray], sizes: np.ndarray, at: np.ndarray, most: int, threshold: float, step: int = 256) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect the rows `at` as all their possible pairs do: those with at most `most` differing bits and sizes within the threshold.

    A search from row to row that compares only with rows not yet reached: in a
    dense group the first rows reach all others.
    """
    left, right, open_ = [], [], at
    while len(open_) > 1:
        front, open_ = open_[:1], open_[1:]
        while len(front) and len(open_):
            now, front = front[:step], front[step:]
            near = sum(np.bitwise_count(w[now][:, None] ^ w[open_][None, :]).astype(np.uint16) for w in words) <= most
            lo, hi = np.minimum(sizes[now][:, None], sizes[open_][None, :]), np.maximum(sizes[now][:, None], sizes[open_][None, :])
            near &= lo >= threshold * hi
            hit = near.any(axis=0)
            if hit.any():
                found = open_[hit]
                left.append(now[near[:, hit].argmax(axis=0)])
                right.append(found)
                front, open_ = np.concatenate([front, found]), open_[~hit]
    return left, right


def possible_links(reps: DataFrame, threshold: float, n_bits: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that connect all nodes of `reps` (node, n, bands, bits) that share a band and may be similar."""
    flat = reps.select("node", F.explode("bands").alias("h"))
    full = flat.groupBy("h").agg(F.count("*").alias("size")).where("size > 1").select(F.col("h").alias("_h"), F.ceil(F.col("size") / bucket).cast("int").alias("blocks"))
    shared = durable(flat.join(full, F.col("h") == F.col("_h")).select("node", "h", "blocks"))
    known = reps.select(F.col("node").alias("_node"), "n", "bits")
    shared = shared.withColumn("own", F.pmod(F.xxhash64("node", "h"), F.col("blocks")).cast("int")).join(known, F.col("node") == F.col("_node")).drop("_node")
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    bins = max(1, reps.count() // TASK * 4)
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("h"), F.lit(bins))).otherwise(F.xxhash64("h", "lo", "hi"))
    most = most_bits(n_bits, threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "lo", "hi", "node"], ignore_index=True)
        node, sizes = pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        bits = np.stack(pdf["bits"].to_numpy()).astype(np.int64).view(U)
        words = [np.ascontiguousarray(bits[:, i]) for i in range(bits.shape[1])]
        h, lo, hi = (pdf[c].to_numpy() for c in ("h", "lo", "hi"))
        edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
        begin, size = edge[:-1], np.diff(edge)
        two = begin[size == 2]  # most buckets are pairs
        near = (sum(np.bitwise_count(w[two] ^ w[two + 1]).astype(np.uint16) for w in words) <= most) & (np.minimum(sizes[two], sizes[two + 1]) >= threshold * np.maximum(sizes[two], sizes[two + 1]))
        left, right = [two[near]], [two[near] + 1]
        for s, k in zip(begin[size > 2], size[size > 2]):
            a, b = forest(words, sizes, np.arange(s, s + k), most, threshold)
            left += a
            right += b
        return pd.DataFrame({"a": node[np.concatenate(left)], "b": node[np.concatenate(right)]}).drop_duplicates()

    return shared.select("node", "h", "lo", "hi", "n", "bits", task.alias("task")).groupBy("task").applyInPandas(run, "a long, b long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, shingles: int = SHINGLES, bucket: int = BUCKET) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, k1, k2, class_id, n_links, kept.

    `n_links` counts the other rows whose set of word five-grams has Jaccard
    similarity >= `threshold` with the row's, copies included; `class_id` is the
    smallest doc_id reachable by such links; `kept` says that it is the row's own.
    Words are runs between white space, compared as they are. A text of one to
    four words has one shingle, all of it. Null and blank texts and rows without
    an id have no links, and classes of their own. Repeated rows count as copies
    of each other. Ties at the threshold are links. Texts of any length are read
    whole. Other columns are ignored, whatever their names;
    an empty table gives an empty one. k1 and k2 stand for the text's words.
    """
    bands, rows = banding(threshold, recall)
    base = durable(signatures(docs, bands, rows))
    usable = base.where("n_shingles > 0 and id is not null")
    # Texts, not ids, are the nodes: an id may be repeated with another text.
    reps = durable(usable.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")).withColumn("node", F.xxhash64("k1", "k2")))
    clusters = connected_components(possible_links(reps, threshold, bands * rows, bucket)).withColumnRenamed("id", "_node")
    members = durable(reps.drop("bits").join(clusters, F.col("node") == F.col("_node")).drop("_node").withColumnRenamed("component", "cluster"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    n_blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("total") / shingles)).cast("int")
    sizes = sizes.select(F.col("cluster").alias("_cluster"), n_blocks.alias("blocks"))
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, -(-total // (shingles // 2)))
    cut = members.join(sizes, F.col("cluster") == F.col("_cluster")).drop("_cluster")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node", "cluster"), F.col("blocks")).cast("int"))
    text = docs.select(F.col("doc_id").alias("_id"), "text").where("text is not null")
    grams = shingle_sets(cut.select(F.col("node").alias("id"), F.col("id").alias("_doc"), "k1", "k2", "w", "bands", "cluster", "block", "blocks").join(text, F.col("_doc") == F.col("_id")).drop("_doc", "_id"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = grams.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    # Small clusters share tasks; a pair of blocks of a large one is a task of its own.
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", "lo", "hi"))
    found = durable(verified(spread.withColumn("task", task), threshold))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "_n")
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "_c")
    whole = reps.select("k1", "k2", "id", "w", "node").join(links, F.col("node") == F.col("_n"), "left").join(components, F.col("node") == F.col("_c"), "left")
    named = durable(whole.select("k1", "k2", "id", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    first = named.groupBy("component").agg(F.min("id").alias("class_id")).withColumnRenamed("component", "_component")
    known = named.join(first, F.col("component") == F.col("_component")).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "class_id", (F.col("links") + F.col("w") - 1).alias("n_links"))
    out = base.select("id", "k1", "k2", "n_shingles").join(known, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n_shingles") > 0) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias("doc_id"), "k1", "k2", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.coalesce("class_id", "id") == F.col("id"), F.lit(False)).alias("kept"))


def first_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all columns as they are, whatever their names, that stand for their class of similar documents: one row of each class.

    Rows with one doc_id are one document, so of several with the class's first
    id one stays. Null and blank texts and rows without an
    id have no similar ones and stay; an empty table gives an empty one.
    """
    join = jaccard_join(docs, **options)
    drop = join.where("n_links > 0").groupBy("doc_id").agg(F.max(F.col("kept").cast("int")).alias("_kept")).withColumnRenamed("doc_id", "_id")
    rows, name = disguised(docs)
    left = rows.join(drop, F.col(name["doc_id"]) == F.col("_id"), "left").where("_id is null or _kept = 1")
    # Rows that are not linked are windows of their own, so those without an id don't meet in one task.
    left = left.withColumn("_alone", F.when(F.col("_id").isNull(), F.monotonically_increasing_id()))
    nth = F.row_number().over(Window.partitionBy(name["doc_id"], "_alone").orderBy(F.xxhash64(name["text"])))
    return left.withColumn("_nth", nth).where("_nth = 1").select(*rows.columns).toDF(*docs.columns)
