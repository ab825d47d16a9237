"""Command line: run, cohort, evaluate, validate, generate-synthetic."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from ..operators import checks
from ..sources import synthetic, tables
from . import pipeline
from .config import load


def session() -> SparkSession:
    return SparkSession.builder.appName("entwine").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def validate(spark: SparkSession, matching: str, candidate: str, test_dir: str, check_ids: bool = False) -> list[dict]:
    """Findings about two result files; matches outside the candidates are a warning."""
    s1 = tables.read_records(spark, f"{test_dir}/test_source1.tsv", "S1", "test").select(F.col("entity_id").alias("s1"))
    valid = None
    if check_ids:
        valid = tables.read_records(spark, f"{test_dir}/test_source2.tsv", "S2", "test").unionByName(tables.read_records(spark, f"{test_dir}/test_source3.tsv", "S3", "test"))
    out = []
    for path, header in ((matching, tables.MATCHING_HEADER), (candidate, tables.CANDIDATE_HEADER)):
        out += [{"file": path, "level": "error", **r.asDict()} for r in checks.check_list_file(spark, path, header, s1, valid).collect()]
    if not any(f["finding"] == "bad_header" for f in out):
        pairs = lambda path, h: tables.read_tsv(spark, path, h).select(F.col(h[0]).alias("s1"), F.explode(tables.id_list(F.col(h[1]))).alias("r"))
        n = checks.subset_violations(pairs(matching, tables.MATCHING_HEADER), pairs(candidate, tables.CANDIDATE_HEADER)).count()
        if n:
            out.append({"file": matching, "level": "warning", "finding": "outside_candidates", "n": n, "examples": []})
    return out


def generate(spark: SparkSession, directory: str, train_size: int, test_size: int, seed: int) -> None:
    """Synthetic splits as tab-separated files (folders of part files)."""
    for split, n, s in (("train", train_size, seed), ("test", test_size, seed + 1)):
        s1, pool, gold = synthetic.registry(spark, n, seed=s)
        for k, df in (("1", s1), ("2", pool.where("source = 'S2'")), ("3", pool.where("source = 'S3'"))):
            lines = df.coalesce(1).orderBy("row_ord").select(F.concat_ws("\t", *tables.RECORD.names).alias("value"))
            head = spark.createDataFrame([("\t".join(tables.RECORD.names),)], "value string")
            head.coalesce(1).union(lines).coalesce(1).write.mode("overwrite").text(f"{directory}/{split}/{split}_source{k}.tsv")
        if split == "train":
            lists = tables.as_lists(s1.select(F.col("entity_id").alias("s1"), "row_ord"), gold, tables.MATCHING_HEADER).coalesce(1).orderBy("row_ord").select(F.concat_ws("\t", *tables.MATCHING_HEADER).alias("value"))
            head = spark.createDataFrame([("\t".join(tables.MATCHING_HEADER),)], "value string")
            head.coalesce(1).union(lists).coalesce(1).write.mode("overwrite").text(f"{directory}/{split}/{split}_ground_truth.tsv")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="entwine")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("run", help="train, match and write results")
    p.add_argument("--config")
    p.add_argument("--steps", default="all", help="all, from:STEP or a comma list of " + ", ".join(pipeline.STEPS))
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    for name, about in (("cohort", "train on a cohort of the training split and report on another"), ("evaluate", "report on the saved model")):
        p = sub.add_parser(name, help=about)
        p.add_argument("--config")
        p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        if name == "cohort":
            p.add_argument("--n-val", type=int, default=2500)
            p.add_argument("--n-train", type=int, default=10_000)
            p.add_argument("--n-distractors", type=int, default=40_000)
    p = sub.add_parser("validate", help="check result files")
    p.add_argument("--matching", required=True)
    p.add_argument("--candidates", required=True)
    p.add_argument("--test-dir", required=True)
    p.add_argument("--check-ids", action="store_true")
    p = sub.add_parser("generate-synthetic", help="write synthetic splits")
    p.add_argument("--dir", default="dataset")
    p.add_argument("--train-size", type=int, default=100)
    p.add_argument("--test-size", type=int, default=50)
    p.add_argument("--seed", type=int, default=42)
    a = parser.parse_args(argv)
    spark = session()
    if a.command == "generate-synthetic":
        generate(spark, a.dir, a.train_size, a.test_size, a.seed)
        return 0
    if a.command == "validate":
        found = validate(spark, a.matching, a.candidates, a.test_dir, a.check_ids)
        for f in found:
            print(f"{f['level'].upper()} {f['file']}: {f['finding']} ({f['n']}) {f['examples']}")
        bad = any(f["level"] == "error" for f in found)
        print("FAIL" if bad else "PASS")
        return int(bad)
    config = load(a.config)
    given = {}
    for x in a.set:
        name, _, value = x.partition("=")
        try:
            given[name] = json.loads(value)
        except ValueError:
            given[name] = value
    config = config.merged(given)
    if a.command == "cohort":
        report = pipeline.cohort_run(spark, config, a.n_val, a.n_train, a.n_distractors)
    elif a.command == "evaluate":
        report = pipeline.evaluate(spark, config)
    else:
        report = pipeline.run(spark, config, a.steps)
    print(json.dumps(report, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
