"""Scores of all pairs in a block without a table of the pairs: cells of a grid, each with its best pairs.

A block's distinct S1 sides are dealt to chunks, its pool sides as well, and a
cell has one chunk of each. Only the sides travel, once for each chunk of the
other kind; scores stay in the cell, and its best pairs alone leave it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: S1 sides and pool sides of a cell.
OWN_CHUNK, POOL_CHUNK = 2048, 32768


def cells(own: DataFrame, other: DataFrame, keys: list[str], more: DataFrame | None = None, chunks: tuple[int, int] = (OWN_CHUNK, POOL_CHUNK)) -> DataFrame:
    """The rows of `own` and `other` (`nid` and equal columns) with the numbers of their cells inside `keys`; rows of `more` are in each cell."""
    size = lambda df, name, chunk: df.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias(name))
    cuts = size(own, "_ns", chunks[0]).join(size(other, "_np", chunks[1]), keys)
    n = cuts.agg(F.sum(F.col("_ns") * F.col("_np"))).first()[0] or 1
    of = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    rows = own.join(cuts, keys).withColumns({"sc": of("_ns"), "pc": every("_np")}).unionByName(other.join(cuts, keys).withColumns({"pc": of("_np"), "sc": every("_ns")}))
    if more is not None:
        rows = rows.unionByName(more.join(cuts, keys).withColumn("sc", every("_ns")).withColumn("pc", every("_np")))
    # A cell is little to read and much to do, so cells are dealt by their number, not by their bytes.
    return rows.drop("_ns", "_np").repartition(max(2, 2 * int(n)), *keys, "sc", "pc")


def ngrams(text: str, least: int = 2, most: int = 4) -> Iterator[str]:
    """As `channels.char_ngrams`; a word with its blanks has three characters or more."""
    for w in re.split("[ \t\n\v\f\r]+", text):
        if w:
            p = f" {w} "
            for n in range(least, most + 1):
                yield from (p[i : i + n] for i in range(len(p) - n + 1))


def postings(lists: list[list]) -> dict:
    """value -> the places of the lists that hold it."""
    found = defaultdict(list)
    for i, values in enumerate(lists):
        for v in values:
            found[v].append(i)
    return {v: np.array(at) for v, at in found.items()}


def cosines(k: int, least: float, max_df: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a cell of names (side 0, 1 by first row, with n equal rows) and n-grams (side 2, in n texts): the pairs of names among whose rows an S1's k best can be."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side, total = pdf["side"].to_numpy(), pdf["total"].iloc[0]
        grams = pdf[side == 2]
        idf = {g: np.log((1.0 + total) / (1.0 + df)) + 1 for g, df in zip(grams["x"], grams["n"])}
        common = set(grams["x"][grams["n"] > max_df]) if max_df is not None else set()

        def unit(x: str) -> dict[str, float]:
            w = {g: (1 + np.log(c) if c > 1 else 1.0) * idf[g] for g, c in Counter(ngrams(x)).items()}
            norm = sum(v * v for v in w.values()) ** 0.5
            return {g: v / norm for g, v in w.items() if g not in common}

        own, pool = pdf[side == 0], pdf[side == 1].sort_values(["r_ord", "r"])
        places, weights = defaultdict(list), defaultdict(list)
        for i, x in enumerate(pool["x"]):
            for g, w in unit(x).items():
                places[g].append(i)
                weights[g].append(w)
        index = {g: (np.array(at), np.array(weights[g])) for g, at in places.items()}
        ids, rows = pool["nid"].to_numpy(), np.minimum(pool["n"].to_numpy(), k)
        out = []
        for nid, x in zip(own["nid"], own["x"]):
            score = np.zeros(len(ids))
            for g, w in unit(x).items():
                if g in index:
                    at, v = index[g]
                    score[at] += w * v
            hits = np.flatnonzero(score > least)
            if len(hits) > k:
                hits = hits[score[hits] >= np.partition(score[hits], -k)[-k] - 2e-9]
            rounded = np.round(score[hits], 9)
            order = np.lexsort((hits, -rounded))
            hits, rounded = hits[order], rounded[order]
            # Before a name's first row are all rows of better names and the first rows of equal ones before it.
            begin = np.searchsorted(-rounded, -rounded, "left")
            before = np.concatenate([[0], np.cumsum(rows[hits])])[begin] + np.arange(len(hits)) - begin
            hits = hits[before < k]
            out.append(pd.DataFrame({"own": nid, "pool": ids[hits], "score": score[hits]}))
        return pd.concat(out) if out else pd.DataFrame({"own": [], "pool": [], "score": []})

    return run


def jaccards(k: int, min_shared: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a cell of token sets (side 0, 1) the k best pairs of each S1 by Jaccard similarity; `listed` are the tokens by which a pool record is found."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        own, pool = pdf[side == 0], pdf[side == 1].sort_values(["r_ord", "r"])
        found, whole = postings(pool["listed"]), postings(pool["tokens"])
        sizes, ords, ids = np.array([len(x) for x in pool["tokens"]]), pool["r_ord"].to_numpy(), pool["r"].to_numpy()
        out = []
        for nid, tokens in zip(own["nid"], own["tokens"]):
            shared, both = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
            for w in tokens:
                if len(w) >= 2 and w in found:
                    shared[found[w]] += 1
                if w in whole:
                    both[whole[w]] += 1
            hits = np.flatnonzero(shared >= (1 if len(tokens) == 1 else max(1, min_shared)))
            score = shared[hits] / (len(tokens) + sizes[hits] - both[hits])
            best = np.lexsort((hits, -np.round(score, 9)))[:k]
            out.append(pd.DataFrame({"own": nid, "r": ids[hits[best]], "r_ord": ords[hits[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"own": [], "r": [], "r_ord": [], "score": []})

    return run
