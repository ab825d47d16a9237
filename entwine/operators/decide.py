"""Decisions: exclusive use of pool records, thresholds, and the set that maximises expected F0.5."""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def exclusivity(pairs: DataFrame, p: str = "p", delta: float = 0.2, shrink: float = 0.5, hard: bool = False) -> DataFrame:
    """Let a pool record's best entity keep its probability: others lose theirs if they are `delta` behind (or `hard`),
    else they shrink. Only probabilities above 0 compete; the first entity wins ties."""
    w = Window.partitionBy("r").orderBy(F.desc(p), "s1")
    best = F.max(p).over(Window.partitionBy("r"))
    df = pairs.withColumns({"_n": F.row_number().over(w), "_best": best})
    lost = F.lit(0.0) if hard else F.when(F.col("_best") - F.col(p) >= delta, F.lit(0.0)).otherwise(F.col(p) * shrink)
    return df.withColumn(p, F.when((F.col("_n") == 1) | (F.col(p) <= 0), F.col(p)).otherwise(lost)).drop("_n", "_best")


def exclusive_after(selected: DataFrame, p: str = "p") -> DataFrame:
    """Each pool record once, with its most probable entity."""
    w = Window.partitionBy("r").orderBy(F.desc(p), "s1")
    return selected.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _ranked(pairs: DataFrame, p: str) -> DataFrame:
    return pairs.withColumn("rk", F.row_number().over(Window.partitionBy("s1").orderBy(F.desc(p), "r")))


def global_threshold(pairs: DataFrame, p: str = "p", threshold: float = 0.5) -> DataFrame:
    return pairs.where(F.col(p) >= threshold)


def top1_threshold(pairs: DataFrame, p: str = "p", threshold: float = 0.5) -> DataFrame:
    return _ranked(pairs, p).where((F.col("rk") == 1) & (F.col(p) >= threshold)).drop("rk")


def two_thresholds(pairs: DataFrame, p: str = "p", first: float = 0.5, extra: float = 0.67) -> DataFrame:
    """The best pair at `first`, the following ones at `extra`, up to the first that fails."""
    ok = F.when(F.col("rk") == 1, F.col(p) >= first).otherwise(F.col(p) >= extra).cast("int")
    w = Window.partitionBy("s1").orderBy("rk")
    return _ranked(pairs, p).withColumn("_ok", F.min(ok).over(w)).where("_ok = 1").drop("_ok", "rk")


def count_distribution(ps: Column) -> Column:
    """The distribution of the number of successes of independent trials: an array of size n + 1."""
    one = F.array(F.lit(1.0))
    zero = F.array(F.lit(0.0))
    return F.aggregate(ps, one, lambda pmf, p: F.zip_with(F.concat(F.transform(pmf, lambda x: x * (1 - p)), zero), F.concat(zero, F.transform(pmf, lambda x: x * p)), lambda a, b: a + b))


def best_prefix(ps: np.ndarray, lam: float, most: int = 14, kmax: int = 15) -> tuple[int, float]:
    """(k, value): how many of the probabilities, highest first, to select for the largest expected F0.5.

    Up to three missed links follow a Poisson distribution with mean lam. Choosing none
    scores the chance that there is no link at all. Ties keep the smaller k.
    """
    ps = ps[:most]
    n = len(ps)
    missed = np.array([exp(-lam) * lam**j / factorial(j) for j in range(4)])
    missed /= missed.sum()
    heads, tails = [np.ones(1)], [np.ones(1)]
    for p in ps:
        heads.append(np.convolve(heads[-1], [1 - p, p]))
    for p in ps[::-1]:
        tails.append(np.convolve(tails[-1], [1 - p, p]))
    best, value = 0, -1.0
    for k in range(min(kmax, n) + 1):
        outside = np.convolve(tails[n - k], missed)
        if k == 0:
            v = float(outside[0])
        else:
            a, c = np.arange(1, k + 1)[:, None], np.arange(len(outside))[None, :]
            v = float((heads[k][1:, None] * outside[None, :] * 5 * a / (4 * k + a + c)).sum())
        if v > value + 1e-12:
            best, value = k, v
    return best, value


def expected_f05(pairs: DataFrame, p: str = "p", lam: float = 0.03, beta: float = 0.0, kmax: int = 15, pmin: float = 1e-6, most: int = 14) -> DataFrame:
    """The pairs to select: per entity the prefix of its pairs with the largest expected F0.5.

    `beta` shifts the log-odds. The first `most` pairs above `pmin` count, which
    are all that a task needs of an entity.
    """
    clipped = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(p)))
    shifted = clipped if beta == 0 else 1 / (1 + F.exp(-(F.log(clipped / (1 - clipped)) + beta)))
    ranked = _ranked(pairs.withColumn("_q", shifted), "_q").where((F.col("rk") <= most) & (F.col("_q") > pmin))

    @F.pandas_udf("int")
    def choose(ps: pd.Series) -> pd.Series:
        return pd.Series([best_prefix(np.asarray(x, float), lam, most, kmax)[0] for x in ps], dtype="int32")

    lists = ranked.groupBy("s1").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "_q"))), lambda x: x["_q"]).alias("_ps"))
    chosen = lists.select("s1", choose("_ps").alias("_k"))
    return ranked.join(chosen, "s1").where(F.col("rk") <= F.col("_k")).drop("_q", "rk", "_k")


def expected_f05_meanfield(pairs: DataFrame, p: str = "p", lam: float = 0.0, beta: float = 0.0, most: int = 20) -> DataFrame:
    """The same by expected counts: 5 S_k / (4 k + S) against the chance of no link, all in window sums."""
    clipped = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(p)))
    q = F.col(p) if beta == 0 else F.when(F.col(p) > 0, 1 / (1 + F.exp(-(F.log(clipped / (1 - clipped)) + beta)))).otherwise(0.0)
    w = Window.partitionBy("s1")
    df = _ranked(pairs, p).where(F.col("rk") <= most).withColumn("_q", q)
    df = df.withColumns({"_s": F.sum("_q").over(w.orderBy("rk")), "_all": F.sum("_q").over(w), "_none": F.exp(F.sum(F.log(F.greatest(1 - F.col("_q"), F.lit(1e-300)))).over(w))})
    df = df.withColumn("_v", 5 * F.col("_s") / (4 * F.col("rk") + F.col("_all") + lam))
    df = df.withColumn("_best", F.max(F.struct(F.round("_v", 12), -F.col("rk"))).over(w))
    k = -F.col("_best.col2")
    return df.where((F.col("rk") <= k) & (F.col("_none") < F.col("_best.col1"))).drop("rk", "_q", "_s", "_all", "_none", "_v", "_best")


def sweep(pairs: DataFrame, gold_sizes: DataFrame, rule: str, grid: list[tuple[float, ...]], p: str = "p", most: int = 20) -> DataFrame:
    """(params..., macro_f05) of a rule for every setting of the grid, in one pass.

    `pairs` has s1, r, y and p; `gold_sizes` has s1 and g for every entity. The
    grid is a short list; each entity's first `most` pairs become an array, and
    every setting is a fold over it, so nothing is joined or multiplied by pairs.
    Rules: global (t), two_threshold (t1, t2), expected_f (beta).
    """
    ranked = _ranked(pairs, p).where(F.col("rk") <= most)
    lists = ranked.groupBy(F.col("s1").alias("_s1")).agg(F.array_sort(F.collect_list(F.struct("rk", F.col(p).alias("p"), F.col("y").cast("int").alias("y")))).alias("_l"))
    every = gold_sizes.join(lists, F.col("s1") == F.col("_s1"), "left").withColumn("_l", F.coalesce("_l", F.array().cast("array<struct<rk:int,p:double,y:int>>")))
    n = len(grid[0])
    settings = F.explode(F.array(*(F.struct(*(F.lit(float(x)).alias(f"x{i}") for i, x in enumerate(g))) for g in grid)))
    df = every.withColumn("_g", settings)
    x = lambda i: F.col(f"_g.x{i}")
    if rule == "global":
        chosen = F.filter("_l", lambda e: e["p"] >= x(0))
    elif rule == "two_threshold":
        start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("k"))
        k = F.aggregate("_l", start, lambda s, e: F.struct((s["on"] & (e["p"] >= F.when(e["rk"] == 1, x(0)).otherwise(x(1)))).alias("on"), (s["k"] + F.when(s["on"] & (e["p"] >= F.when(e["rk"] == 1, x(0)).otherwise(x(1))), 1).otherwise(0)).alias("k")), lambda s: s["k"])
        chosen = F.slice("_l", F.lit(1), k)
    elif rule == "expected_f":
        shift = lambda q: F.when(q > 0, 1 / (1 + F.exp(-(F.log(F.greatest(q, F.lit(1e-9)) / F.greatest(1 - q, F.lit(1e-9))) + x(0))))).otherwise(0.0)
        total = F.aggregate("_l", F.lit(0.0), lambda s, e: s + shift(e["p"]))
        none = F.aggregate("_l", F.lit(1.0), lambda s, e: s * (1 - shift(e["p"])))
        start = F.struct(F.lit(0.0).alias("s"), F.lit(-1.0).alias("v"), F.lit(0).alias("k"))

        def step(s, e):
            grown = s["s"] + shift(e["p"])
            v = 5 * grown / (4 * e["rk"] + total)
            return F.struct(grown.alias("s"), F.greatest(s["v"], v).alias("v"), F.when(v > s["v"], e["rk"]).otherwise(s["k"]).alias("k"))

        k = F.aggregate("_l", start, step, lambda s: F.when(none >= s["v"], 0).otherwise(s["k"]))
        chosen = F.slice("_l", F.lit(1), k)
    else:
        raise ValueError(f"unknown rule {rule}")
    df = df.withColumn("_c", chosen).withColumns({"_k": F.size("_c"), "_tp": F.aggregate("_c", F.lit(0), lambda s, e: s + e["y"])})
    f = F.when(F.col("g") == 0, (F.col("_k") == 0).cast("double")).otherwise(5 * F.col("_tp") / (4 * F.col("_k") + F.col("g")))
    return df.groupBy(*(x(i).alias(f"x{i}") for i in range(n))).agg(F.avg(f).alias("macro_f05"))


def best_prefixes(ps: np.ndarray, betas: np.ndarray, lams: np.ndarray, most: int = 14, kmax: int = 15, pmin: float = 1e-6) -> np.ndarray:
    """`best_prefix` for every shift and every mean at once: (betas, lams) numbers of pairs to select; ps falls."""
    clipped = np.clip(ps[:most], 1e-7, 1 - 1e-7)
    q = 1 / (1 + np.exp(-(np.log(clipped / (1 - clipped))[None, :] + betas[:, None])))
    q[:, :] = np.where(q > pmin, q, 0.0)  # a pair that no longer counts is a sure miss and never selected
    n, b = q.shape[1], len(betas)
    heads, tails = np.zeros((n + 1, b, n + 1)), np.zeros((n + 1, b, n + 1))
    heads[0, :, 0] = tails[n, :, 0] = 1.0
    for k in range(n):
        heads[k + 1] = heads[k] * (1 - q[:, k : k + 1])
        heads[k + 1, :, 1:] += heads[k, :, :-1] * q[:, k : k + 1]
    for k in range(n - 1, -1, -1):
        tails[k] = tails[k + 1] * (1 - q[:, k : k + 1])
        tails[k, :, 1:] += tails[k + 1, :, :-1] * q[:, k : k + 1]
    out = np.zeros((b, len(lams)), np.int64)
    a = np.arange(1, n + 1)[:, None]
    for j, lam in enumerate(lams):
        missed = np.array([exp(-lam) * lam**i / factorial(i) for i in range(4)])
        missed /= missed.sum()
        outside = np.zeros((n + 1, b, n + 4))
        for i in range(4):
            outside[:, :, i : i + n + 1] += tails * missed[i]
        best, value = np.zeros(b, np.int64), outside[0, :, 0].copy()
        for k in range(1, min(kmax, n) + 1):
            gain = 5 * a / (4 * k + a + np.arange(n + 4)[None, :])
            v = np.einsum("ba,bc,ac->b", heads[k][:, 1:], outside[k], gain)
            better = (v > value + 1e-12) & (q[:, k - 1] > 0)
            best, value = np.where(better, k, best), np.where(better, v, value)
        out[:, j] = best
    return out


def sweep_exact(pairs: DataFrame, gold_sizes: DataFrame, betas: list[float], lams: list[float], p: str = "p", most: int = 14) -> DataFrame:
    """(x0: beta, x1: lam, macro_f05): the exact rule under every shift and mean number of missed links, in one pass.

    Tasks add up their entities' F0.5 per setting, so what is shuffled is a row per task and setting.
    """
    ranked = _ranked(pairs, p).where(F.col("rk") <= most)
    lists = ranked.groupBy(F.col("s1").alias("_s1")).agg(F.array_sort(F.collect_list(F.struct("rk", F.col(p).alias("p"), F.col("y").cast("int").alias("y")))).alias("l"))
    every = gold_sizes.join(lists, F.col("s1") == F.col("_s1"), "left").select(F.col("g").cast("long").alias("g"), F.col("l.p").alias("ps"), F.col("l.y").alias("ys"))
    b, m = np.asarray(betas, float), np.asarray(lams, float)

    def run(frames):
        total, n = np.zeros((len(b), len(m))), 0
        for pdf in frames:
            for g, ps, ys in zip(pdf["g"], pdf["ps"], pdf["ys"]):
                n += 1
                if ps is None or not len(ps):
                    total += g == 0
                    continue
                k = best_prefixes(np.asarray(ps, float), b, m, most)
                tp = np.concatenate([[0], np.cumsum(ys)])[k]
                total += (k == 0) if g == 0 else 5 * tp / (4 * k + g)
        yield pd.DataFrame({"i": np.repeat(np.arange(len(b)), len(m)), "j": np.tile(np.arange(len(m)), len(b)), "f": total.ravel(), "n": n})

    summed = every.mapInPandas(run, "i int, j int, f double, n long").groupBy("i", "j").agg((F.sum("f") / F.sum("n")).alias("macro_f05"))
    at = lambda xs, c: F.get(F.array(*map(F.lit, map(float, xs))), F.col(c))
    return summed.select(at(b, "i").alias("x0"), at(m, "j").alias("x1"), "macro_f05")


def grids() -> dict[str, list[tuple[float, ...]]]:
    """The settings that are tried: of the threshold rules and of the shift."""
    return {
        "global": [(round(float(t), 3),) for t in np.linspace(0.05, 0.95, 91)],
        "two_threshold": [(round(float(a), 3), round(float(b), 3)) for a in np.linspace(0.1, 0.9, 17) for b in np.linspace(0.1, 0.95, 18)],
        "expected_f": [(round(float(b), 2),) for b in np.linspace(-2, 2, 41)],
        "cv_global": [(float(t),) for t in np.linspace(0.2, 0.85, 27)],
        "cv_two_threshold": [(float(a), float(b)) for a in np.linspace(0.35, 0.65, 7) for b in np.linspace(0.55, 0.85, 7) if b >= a],
    }


# The shifts and the mean numbers of missed links that are tried for the exact rule.
EXACT_BETAS = [round(float(b), 2) for b in np.linspace(-1.5, 1.5, 31)]
EXACT_LAMS = [0.005, 0.01, 0.02, 0.04]


def tune(pairs: DataFrame, gold_sizes: DataFrame, rules: tuple[str, ...], p: str = "p") -> dict[str, tuple[tuple[float, ...], float]]:
    """The best setting and its macro F0.5 of every rule: global (t), two_threshold (t1, t2), expected_f (beta), exact (beta, lam)."""
    g, out = grids(), {}
    for rule in rules:
        swept = sweep_exact(pairs, gold_sizes, EXACT_BETAS, EXACT_LAMS, p) if rule == "exact" else sweep(pairs, gold_sizes, rule, g[rule], p)
        out[rule] = best_setting(swept)
    return out


def decide(pairs: DataFrame, rule: str, params: tuple[float, ...], p: str = "p") -> DataFrame:
    """The pairs that a rule selects."""
    if rule == "global":
        return global_threshold(pairs, p, params[0])
    if rule == "two_threshold":
        return two_thresholds(pairs, p, *params)
    if rule == "expected_f":
        return expected_f05_meanfield(pairs, p, beta=params[0])
    if rule == "exact":
        return expected_f05(pairs, p, params[1], params[0])
    raise ValueError(f"unknown rule {rule}")


def best_setting(swept: DataFrame) -> tuple[tuple[float, ...], float]:
    """The first setting with the highest score."""
    names = [c for c in swept.columns if c.startswith("x")]
    row = swept.orderBy(F.round("macro_f05", 12).desc(), *names).first()
    return tuple(row[c] for c in names), row.macro_f05


def first_come(pairs: DataFrame, order: str = "row_ord") -> DataFrame:
    """Each pool record with the first entity in file order that has it."""
    w = Window.partitionBy("r").orderBy(order, "s1")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def probability_lists(pairs: DataFrame, p: str = "p", most: int = 20) -> DataFrame:
    """(s1, ps): each entity's highest probabilities, in falling order."""
    ranked = _ranked(pairs, p).where(F.col("rk") <= most)
    return ranked.groupBy("s1").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", p))), lambda x: x[p]).alias("ps"))
