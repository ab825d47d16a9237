"""Sharding by Karmarkar-Karp differencing, law `bytes`: near-equal bytes in each shard.

Equal texts are an indivisible group. A partial partition is a list of shard
sums; differencing takes the two with the largest spread and adds them in
opposite order, the largest of one to the smallest of the other, until one is
left. Groups are dealt by hash to chunks of bounded size that are differenced in
parallel; each chunk ends as one partial partition, with which the method goes
on, level by level, until one is left: partial partitions are all it ever needs.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import durable, row_keys, running_sums


def difference(parts: list[list[int]], shards: int) -> tuple[list[list[int]], list[int]]:
    """Merge partial partitions into one by repeated differencing.

    `parts`: each a list of at most `shards` sums. Returns, for each of them, the
    merged shard of each of its sums, and the merged sums. Ties go by position.
    """
    parent: list[int] = []

    def node() -> int:
        parent.append(-1)
        return len(parent) - 1

    own, heap = [], []
    for n, sums in enumerate(parts):
        full = [(s, node()) for s in [*sums, *[0] * (shards - len(sums))]]
        own.append([k for _, k in full[: len(sums)]])
        full.sort(key=lambda x: (-x[0], x[1]))
        heap.append((full[-1][0] - full[0][0], n, full))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, n, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        full = []
        for (s, i), (t, j) in zip(a, reversed(b)):
            k = node()
            parent[i] = parent[j] = k
            full.append((s + t, k))
        full.sort(key=lambda x: (-x[0], x[1]))
        heapq.heappush(heap, (full[-1][0] - full[0][0], n, full))
    if not heap:
        return [], [0] * shards
    last = heap[0][2]
    shard = {k: at for at, (_, k) in enumerate(last)}
    for k in range(len(parent) - 1, -1, -1):  # parents come after their children
        if k not in shard:
            shard[k] = shard[parent[k]]
    return [[shard[k] for k in ks] for ks in own], [s for s, _ in last]


def assign(groups: DataFrame, shards: int = 16, chunk: int = 4096) -> DataFrame:
    """(k1, k2, shard) for groups (k1, k2, bytes): one row per group.

    Levels of chunks: about `chunk` groups in the first, `chunk // shards`
    partial partitions in the next ones, until one partition is left.
    """
    n = groups.count()
    n_chunks = max(1, -(-n // chunk))
    fan = max(2, chunk // shards)

    def leaves(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2"])
        own, sums = difference([[int(b)] for b in pdf["bytes"]], shards)
        out = pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "chunk": key[0], "bin": [x[0] for x in own], "sums": [None] * len(pdf)})
        return pd.concat([out, pd.DataFrame({"k1": [0], "k2": [0], "chunk": [key[0]], "bin": [-1], "sums": [sums]})])

    def inner(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        own, sums = difference([list(map(int, s)) for s in pdf["sums"]], shards)
        out = pd.DataFrame({"chunk": pdf["chunk"], "up": key[0], "map": own, "sums": [None] * len(pdf)})
        return pd.concat([out, pd.DataFrame({"chunk": [-1], "up": [key[0]], "map": [None], "sums": [sums]})])

    dealt = groups.withColumn("chunk", F.pmod(F.xxhash64("k2", "k1"), F.lit(n_chunks)))
    found = durable(dealt.groupBy("chunk").applyInPandas(leaves, "k1 long, k2 long, chunk long, bin int, sums array<long>"))
    level = found.where("bin < 0").select("chunk", "sums")
    placed = found.where("bin >= 0").select("k1", "k2", "chunk", "bin")
    while n_chunks > 1:
        n_chunks = -(-n_chunks // fan)
        merged = durable(level.groupBy(F.floor(F.col("chunk") / fan).cast("long").alias("up")).applyInPandas(inner, "chunk long, up long, map array<int>, sums array<long>"))
        step = merged.where("chunk >= 0").select(F.col("chunk").alias("_chunk"), "up", "map")
        placed = placed.join(step, F.col("chunk") == F.col("_chunk")).select("k1", "k2", F.col("up").alias("chunk"), F.get("map", F.col("bin")).alias("bin"))
        level = merged.where("chunk < 0").select(F.col("up").alias("chunk"), "sums")
    return placed.select("k1", "k2", F.col("bin").alias("shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 16, chunk: int = 4096) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`).

    Equal texts share a shard. Slots number a shard's rows from 0 without gaps,
    in the order of a hash. A null text has size 1 and is a group of its own
    beside the empty text; repeated rows are rows of their own, with slots next
    to each other; texts of any length count whole, and one that is larger than an even share
    fills its shard alone; groups of equal size go by their hashes; other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    k1, k2 = row_keys("text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = durable(docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")))
    groups = rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"))
    to = assign(groups, shards, chunk).withColumnsRenamed({"k1": "_1", "k2": "_2"})
    n = rows.count()
    parts = max(1, -(-n // (shards * 4096)))
    placed = rows.join(to, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))).drop("_1", "_2")
    placed = placed.withColumns({"h": F.xxhash64("doc_id", "k1", "k2"), "one": F.lit(1).cast("long")}).withColumn("part", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts).cast("long"))
    numbered = running_sums(durable(placed), ["shard"], "part", ["h", "doc_id", "k1", "k2"], {"slot": "one"})
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
