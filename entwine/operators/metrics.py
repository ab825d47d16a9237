"""Evaluation: F0.5, blocking quality, calibration, ranking, bootstrap and error analysis, all as aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql.window import Window
from pyspark.sql import Column, DataFrame, functions as F

from .running import running_sums


def f05(tp: Column, predicted: Column, gold: Column) -> Column:
    """5 TP / (4 P + G); without gold 1 if nothing is predicted, else 0."""
    return F.when(gold == 0, (predicted == 0).cast("double")).otherwise(5.0 * tp / (4.0 * predicted + gold))


def per_entity(entities: DataFrame, predicted: DataFrame, gold: DataFrame, distinct: bool = True) -> DataFrame:
    """(s1, p, g, tp, f05) of every entity. With `distinct`, repeated predictions count once."""
    p, g = (predicted.select("s1", "r"), gold.select("s1", "r").distinct()) if not distinct else (predicted.select("s1", "r").distinct(), gold.select("s1", "r").distinct())
    marked = p.withColumns({"_p": F.lit(1), "_g": F.lit(0)}).unionByName(g.withColumns({"_p": F.lit(0), "_g": F.lit(1)}))
    pairs = marked.groupBy("s1", "r").agg(F.sum("_p").alias("p"), F.max("_g").alias("g"))
    sums = pairs.groupBy(F.col("s1").alias("_s1")).agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum(F.col("p") * F.col("g")).alias("tp"))
    rows = entities.select("s1").distinct().join(sums, F.col("s1") == F.col("_s1"), "left").drop("_s1")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("p", "g", "tp")})
    return rows.withColumn("f05", f05(F.col("tp"), F.col("p"), F.col("g")))


def macro(scored: DataFrame) -> DataFrame:
    """One row: macro_f05, singleton_accuracy, non_singleton_f05, n, n_singletons."""
    single = F.col("g") == 0
    return scored.agg(
        F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"), F.coalesce(F.avg(F.when(single, F.col("f05"))), F.lit(0.0)).alias("singleton_accuracy"),
        F.coalesce(F.avg(F.when(~single, F.col("f05"))), F.lit(0.0)).alias("non_singleton_f05"), F.count("*").alias("n"), F.coalesce(F.sum(single.cast("long")), F.lit(0)).alias("n_singletons"),
    )


def singletons(scored: DataFrame) -> DataFrame:
    """One row: accuracy and false-positive rate on entities without links, abstention on those with links."""
    single = F.col("g") == 0
    empty = (F.col("p") == 0).cast("double")
    accuracy = F.coalesce(F.avg(F.when(single, empty)), F.lit(0.0))
    return scored.agg(accuracy.alias("singleton_accuracy"), (1 - accuracy).alias("singleton_false_positive_rate"), F.coalesce(F.avg(F.when(~single, empty)), F.lit(0.0)).alias("non_singleton_abstention_rate"), F.count_if(single).alias("n_singletons"), F.count_if(~single).alias("n_non_singletons"))


def blocking_quality(entities: DataFrame, candidates: DataFrame, gold: DataFrame, n_s1: int, n_pool: int) -> DataFrame:
    """One row: pair completeness, reduction ratio, entity recall, ceiling F0.5, and the number of candidates."""
    s = per_entity(entities, candidates, gold)
    ceiling = F.when(F.col("g") == 0, 1.0).otherwise(5.0 * F.col("tp") / (4.0 * F.col("tp") + F.col("g")))
    cells = float(n_s1) * n_pool
    return s.agg(
        F.when(F.sum("g") > 0, F.sum("tp") / F.sum("g")).otherwise(1.0).alias("pair_completeness"), (1.0 - F.sum("p") / F.lit(cells) if cells else F.lit(1.0)).alias("reduction_ratio"),
        F.avg((F.col("tp") == F.col("g")).cast("double")).alias("entity_recall"), F.avg(ceiling).alias("ceiling_f05"),
        F.avg("p").alias("mean_candidates"), F.percentile("p", F.lit(0.5)).alias("p50_candidates"), F.percentile("p", F.lit(0.99)).alias("p99_candidates"), F.max("p").alias("max_candidates"),
    )


def recall_by(entities: DataFrame, candidates: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, n_gold, n_found, recall) over the entities that have candidates."""
    with_any = candidates.select("s1").distinct()
    labelled = gold.join(with_any, "s1", "left_semi").join(entities.select("s1", key), "s1")
    found = candidates.select("s1", "r", F.lit(1).alias("_hit")).distinct()
    return labelled.join(found, ["s1", "r"], "left").groupBy(key).agg(F.count("*").alias("n_gold"), F.count("_hit").alias("n_found"), (F.count("_hit") / F.count("*")).alias("recall"))


def channel_recall(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(channel, n_found, recall): the share of gold pairs that each channel has."""
    n = gold.agg(F.count("*").alias("n"))
    found = hits.select("s1", "r", "channel").distinct().join(gold, ["s1", "r"]).groupBy("channel").agg(F.count("*").alias("n_found"))
    total = n.first().n
    return found.withColumn("recall", F.col("n_found") / F.lit(max(total, 1)))


def calibration_bins(scored: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y): equal bins of the probability, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def ece(scored: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """One row: the expected calibration error."""
    b = calibration_bins(scored, y, p, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def losses(scored: DataFrame, y: str = "y", p: str = "p", clip: float = 1e-6) -> DataFrame:
    """One row: Brier score and log loss."""
    t, q = F.col(y).cast("double"), F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(p)))
    return scored.agg(F.avg((F.col(p) - t) * (F.col(p) - t)).alias("brier"), F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"))


def auc(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: the area under the ROC curve by rank sums, ties shared; null with one class only.

    Scores, which lie in [0, 1], are counted per value first; the ranks are running sums in two levels.
    """
    per = scored.groupBy(F.col(p).alias("v")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    per = running_sums(per.withColumns({"all": F.lit(0), "chunk": F.floor(F.col("v") * 4096)}), ["all"], "chunk", ["v"], {"below": "n"})
    rank = F.col("below") + (F.col("n") + 1) / 2
    s = per.select("n", "pos", rank.alias("rank")).agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return s.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"))


def bootstrap_difference(a: DataFrame, b: DataFrame, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> dict[str, float]:
    """Paired bootstrap of per-entity F0.5 (s1, f05): mean difference of b over a, its interval, p and significance.

    A resample's mean is that of the differences' histogram under multinomial
    counts: Spark counts each distinct difference, and numpy draws the counts.
    F0.5 has few distinct values, so the histogram is small however many entities there are.
    """
    d = a.select("s1", F.col("f05").alias("_a")).join(b.select("s1", "f05"), "s1").select(F.round(F.col("f05") - F.col("_a"), 12).alias("d"))
    rows = d.groupBy("d").count().orderBy("d").collect()
    if not rows:
        return {"observed_mean_delta": 0.0, "ci_lower": 0.0, "ci_upper": 0.0, "p_value": 1.0, "significant": False}
    values, counts = np.array([r.d for r in rows]), np.array([r["count"] for r in rows], float)
    n = int(counts.sum())
    drawn = np.random.default_rng(seed).multinomial(n, counts / n, resamples) @ values / n
    lower, upper = np.percentile(drawn, [50 * (1 - level), 50 * (1 + level)])
    return {"observed_mean_delta": float(counts @ values / n), "ci_lower": float(lower), "ci_upper": float(upper), "p_value": float((drawn <= 0).mean()), "significant": bool(lower > 0)}


def error_tags(predicted: DataFrame, candidates: DataFrame, gold: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1, r, tag): every wrong pair with its kinds of error.

    Missed pairs are blocking_miss or decision_miss; wrong ones false_positive,
    and besides singleton_violation, branch_confusion (same core, other house
    number) or colocation_confusion (same address, other core).
    """
    mark = lambda df, c: df.select("s1", "r").distinct().withColumn(c, F.lit(True))
    has = gold.select("s1").distinct().withColumn("_linked", F.lit(True))
    pairs = mark(predicted, "_p").join(mark(gold, "_g"), ["s1", "r"], "full").where("_p is null or _g is null").join(mark(candidates, "_c"), ["s1", "r"], "left").join(has, "s1", "left")
    a = s1.select(F.col("entity_id").alias("s1"), F.col("name_core").alias("_ca"), F.col("house_no").alias("_ha"), F.col("addr_norm").alias("_aa"))
    b = pool.select(F.col("entity_id").alias("r"), F.col("name_core").alias("_cb"), F.col("house_no").alias("_hb"), F.col("addr_norm").alias("_ab")).dropDuplicates(["r"])
    pairs = pairs.join(a, "s1", "left").join(b, "r", "left")
    wrong = F.col("_p").isNotNull()
    same = lambda x, y: (F.col(x) != "") & (F.col(x) == F.col(y))
    tags = F.array_compact(F.array(
        F.when(~wrong & F.col("_c").isNull(), F.lit("blocking_miss")), F.when(~wrong & F.col("_c").isNotNull(), F.lit("decision_miss")), F.when(wrong, F.lit("false_positive")),
        F.when(wrong & F.col("_linked").isNull(), F.lit("singleton_violation")),
        F.when(wrong & same("_ca", "_cb") & (F.col("_ha") != "") & (F.col("_hb") != "") & (F.col("_ha") != F.col("_hb")), F.lit("branch_confusion")),
        F.when(wrong & same("_aa", "_ab") & (F.col("_ca") != F.col("_cb")), F.lit("colocation_confusion")),
    ))
    return pairs.select("s1", "r", F.explode(tags).alias("tag"))


def error_examples(tags: DataFrame, s1: DataFrame, pool: DataFrame, n: int = 5) -> DataFrame:
    """(tag, s1, r, name_a, name_b, addr_a, addr_b): the first n pairs of each kind of error, by ids, with what the records say."""
    nth = F.row_number().over(Window.partitionBy("tag").orderBy("s1", "r"))
    few = tags.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")
    a = s1.select(F.col("entity_id").alias("s1"), F.col("business_name").alias("name_a"), F.col("business_address").alias("addr_a"))
    b = pool.select(F.col("entity_id").alias("r"), F.col("business_name").alias("name_b"), F.col("business_address").alias("addr_b"))
    return few.join(a, "s1", "left").join(b, "r", "left").select("tag", "s1", "r", "name_a", "name_b", "addr_a", "addr_b")


def error_profile(predicted: DataFrame, gold: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(key, n, false_positives, false_negatives, macro_f05) by a property of the entities."""
    s = per_entity(entities, predicted, gold).join(entities.select("s1", key), "s1")
    return s.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("p") - F.col("tp")).alias("false_positives"), F.sum(F.col("g") - F.col("tp")).alias("false_negatives"), F.avg("f05").alias("macro_f05"))


def report_card(entities: DataFrame, predicted: DataFrame, gold: DataFrame, extra: dict | None = None, name: str = "run") -> dict:
    """All headline figures of a run as one dictionary."""
    scored = per_entity(entities, predicted, gold)
    return {"run": name, **macro(scored).first().asDict(), **singletons(scored).first().asDict(), **(extra or {})}
