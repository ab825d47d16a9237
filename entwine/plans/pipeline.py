"""The whole run: read, normalise, block, featurise, learn, decide, write.

Plans are cut where results are used many times: after normalisation, after
pruning, and between the stages of the model.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators import candidates as cand, checks, decide, features as feat, learn, metrics
from ..operators.canonical import canonicalize, canonicalize_light, normalise
from ..operators.running import materialise
from ..sources import tables
from .config import Config


@dataclass
class Records:
    """One split: the entities in their order, their records, the pool, and gold links if there are any."""

    entities: DataFrame
    s1: DataFrame
    pool: DataFrame
    gold: DataFrame | None = None


def read_split(spark: SparkSession, directory: str, split: str) -> Records:
    s1, s2, s3 = (tables.read_records(spark, f"{directory}/{split}_source{k}.tsv", f"S{k}", split) for k in (1, 2, 3))
    entities = s1.select(F.col("entity_id").alias("s1"), "row_ord")
    gold = tables.read_links(spark, f"{directory}/{split}_ground_truth.tsv")[1] if split == "train" else None
    pool = tables.pool(s2, s3)
    return Records(entities, s1, pool.withColumn("row_ord", F.col("row_ord") + F.col("is_s3") * F.lit(1 << 40)), gold)


def normalised(r: Records, scheme: str = "full") -> Records:
    fn = {"full": canonicalize, "columnar": normalise, "light": canonicalize_light}[scheme]
    return Records(r.entities, fn(r.s1), fn(r.pool), r.gold)


def blocked(r: Records, c: Config) -> DataFrame:
    """Pruned candidates of normalised records with cand_count."""
    if c.scheme == "full":
        pairs, _ = cand.block_and_prune(r.s1, r.pool, c.budget, c.by_country, c.expansion, list(c.channels), **c.channel_options())
    elif c.scheme == "light":
        found = cand.count_of_keys(*cand.assign_blocks(r.s1, r.pool, c.by_country))
        found = found.groupBy("s1", "r").agg(F.max("score").alias("score"), F.min("rank").alias("ord"))
        pairs = found.withColumns({"mask": F.lit(0).cast("long"), "rank": F.create_map().cast("map<string,int>")})
    else:
        a, b = cand.assign_blocks(r.s1, r.pool, c.by_country)
        pairs = cand.rare_key_candidates(a, b).drop("block")
    return materialise(pairs.withColumn("cand_count", F.count("*").over(Window.partitionBy("s1"))))


def featurised(r: Records, pairs: DataFrame, c: Config) -> tuple[DataFrame, list[str]]:
    """(features, their names) of candidate pairs."""
    if c.scheme in ("full", "light"):
        df, n = feat.document_frequency(r.s1.select("name_core_tokens", "addr_tokens").unionByName(r.pool.select("name_core_tokens", "addr_tokens")))
        found = feat.pair_features(feat.attach(pairs.select("s1", "r", "mask", "rank", "cand_count"), feat.with_idf(r.s1, df, n), feat.with_idf(r.pool, df, n)))
        if c.scheme == "light":
            found = feat.light_features(found)
    else:
        found = feat.columnar_features(feat.attach(pairs, r.s1, r.pool))
        found = found.withColumns({"name_hi_addr_lo": F.lit(0.0), "name_lo_addr_hi": F.lit(0.0), "name_exact_fold": F.col("core_exact"), "name_acronym_match": F.lit(0.0)})
    return materialise(found), [x for x in found.columns if x not in ("s1", "r")]


def with_gold(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates and the gold links that blocking missed, with an empty provenance."""
    missed = gold.join(pairs.select("s1", "r"), ["s1", "r"], "left_anti")
    filled = missed.select("s1", "r", *(F.lit(None).cast(f.dataType).alias(f.name) for f in pairs.schema.fields if f.name not in ("s1", "r")))
    return pairs.unionByName(filled).na.fill(0, [c for c in ("mask", "n_channels", "cand_count") if c in pairs.columns])


def train(r: Records, c: Config) -> tuple[learn.Matcher, dict]:
    """(matcher, report) from a split with gold links."""
    checks.validate_records(r.s1)
    checks.validate_records(r.pool)
    n = normalised(r, c.scheme)
    pairs = blocked(n, c)
    quality = metrics.blocking_quality(n.entities, pairs, n.gold, n.s1.count(), n.pool.count()).first().asDict()
    used = with_gold(pairs, n.gold) if c.inject_gold else pairs
    features, columns = featurised(n, used, c)
    if c.scheme == "light":  # what the weights of hard negatives ask for
        features = features.withColumn("name_acronym_match", F.col("acronym_match"))
    sizes = n.entities.select("s1").join(n.gold.groupBy(F.col("s1").alias("_s")).agg(F.count_distinct("r").alias("g")), F.col("s1") == F.col("_s"), "left").select("s1", F.coalesce("g", F.lit(0)).alias("g"))
    settings = learn.Settings(c.folds, c.boosting_rounds, c.tree_depth, c.learning_rate, c.seed, c.early_stopping, tuple(c.rules))
    matcher, scored = learn.train(features, n.gold, sizes, columns, settings)
    if c.lam is not None:
        matcher.lam = c.lam
    chosen = decide.decide(scored, matcher.rule, matcher.setting(), "pcal").select("s1", "r")
    report = metrics.report_card(n.entities, chosen, n.gold, quality | metrics.losses(scored, "y", "p2b").first().asDict() | metrics.ece(scored, "y", "pcal").first().asDict(), "out_of_fold")
    report |= {"rule": matcher.rule, "setting": list(matcher.setting()), "rules": {k: v for k, v in matcher.metrics.items() if k.startswith("macro_f05_")}}
    report["importances"] = learn.importances(matcher.first, columns)[:20] if matcher.first else []
    if c.country_aucs:
        y = n.gold.select("s1", "r", F.lit(1).alias("y")).distinct()
        labelled = features.join(y, ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
        report["country_aucs"] = learn.country_aucs(labelled, n.s1.select(F.col("entity_id").alias("s1"), "country_norm"), columns, settings)
    matcher.metrics |= {k: float(v) for k, v in report.items() if isinstance(v, (int, float))}
    return matcher, report


def predict(r: Records, matcher: learn.Matcher, c: Config) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches) of a split."""
    n = normalised(r, c.scheme)
    pairs = blocked(n, c)
    features, _ = featurised(n, pairs, c)
    matches = learn.select(matcher, matcher.score(features), c.exclusivity_delta, c.exclusivity_shrink)
    if c.exclusive_after:
        matches = decide.exclusive_after(matches, "pcal")
    ordered = pairs if "ord" in pairs.columns else pairs.withColumn("ord", F.lit(0))
    return ordered.select("s1", "r", "ord"), matches.select("s1", "r")


def baseline(r: Records) -> DataFrame:
    """Matches without a model."""
    n = normalised(r)
    return cand.exact_greedy(n.s1, n.pool)


def _log(step: str, began: float) -> None:
    import resource

    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    print(f"{step}: {time.time() - began:.1f} s, {peak:.0f} MB", flush=True)


def scores(r: Records, matcher: learn.Matcher, c: Config, name: str) -> dict:
    """The report of a matcher on a split with gold links."""
    candidates, matches = (materialise(x) for x in predict(r, matcher, c))
    quality = metrics.blocking_quality(r.entities, candidates, r.gold, r.s1.count(), r.pool.count()).first().asDict()
    return metrics.report_card(r.entities, matches, r.gold, quality, name)


def evaluate(spark: SparkSession, c: Config, split: str = "train") -> dict:
    """The saved model's report on a split with gold links (read from train_dir)."""
    return scores(read_split(spark, c.train_dir, split), learn.Matcher.load(spark, c.model_dir), c, "evaluation")


def cohort_run(spark: SparkSession, c: Config, n_val: int = 2500, n_train: int = 10_000, n_distractors: int = 40_000) -> dict:
    """Train on one cohort of the training split and report on another: entities in file order, their gold records and distractors."""
    r = read_split(spark, c.train_dir, "train")
    found = {k: materialise(x) for k, x in tables.cohort(r.entities, r.gold, r.pool, n_val, n_train, n_distractors).items()}

    def part(name: str) -> Records:
        entities = found[f"{name}_entities"]
        s1 = r.s1.join(entities.select(F.col("s1").alias("entity_id")), "entity_id", "left_semi")
        return Records(entities, s1, found[f"{name}_pool"], found[f"{name}_gold"])

    matcher, report = train(part("train"), c)
    matcher.save(c.model_dir)
    return {"train": report, "validation": scores(part("val"), matcher, c, "validation")}


STEPS = ("validate", "train", "predict", "write")


def save_report(spark: SparkSession, report: dict, path: str) -> None:
    """The report as one line of JSON in the folder `report` under `path`."""
    spark.createDataFrame([(json.dumps(report, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def pick_steps(spec: str) -> list[str]:
    """`all`, `from:step`, or a comma list, in the run's order."""
    if spec == "all":
        return list(STEPS)
    chosen = list(STEPS[STEPS.index(spec[5:]) :]) if spec.startswith("from:") else [s.strip() for s in spec.split(",")]
    unknown = set(chosen) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    return [s for s in STEPS if s in chosen]


def run(spark: SparkSession, c: Config, steps: str = "all", log: Callable[[str, float], None] = _log) -> dict:
    """Run the steps and return the report; the model is kept in model_dir between runs."""
    todo, report = pick_steps(steps), {}
    began = time.time()
    if "validate" in todo:
        r = read_split(spark, c.train_dir, "train")
        report["inputs"] = {"s1": checks.validate_records(r.s1), "pool": checks.validate_records(r.pool)}
        log("validate", began)
    matcher = None
    if "train" in todo:
        matcher, found = train(read_split(spark, c.train_dir, "train"), c)
        matcher.save(c.model_dir)
        report |= found
        log("train", began)
    if "predict" in todo or "write" in todo:
        matcher = matcher or learn.Matcher.load(spark, c.model_dir)
        r = read_split(spark, c.test_dir, "test")
        candidates, matches = (materialise(x) for x in predict(r, matcher, c))
        report["n_candidates"], report["n_matches"] = candidates.count(), matches.count()
        log("predict", began)
        if "write" in todo:
            tables.write_results(r.entities, candidates, matches, c.output_dir, r.pool)
            report["outputs"] = checks.output_report(matches, candidates, r.entities, r.pool).first().asDict()
            save_report(spark, report, c.output_dir)
            log("write", began)
    return report
