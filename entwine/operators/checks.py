"""Checks of inputs, of gold links, and of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


class InputError(ValueError):
    """Records that can't be used."""


def record_report(records: DataFrame) -> DataFrame:
    """One row of counts: rows, empty and repeated ids, wrong prefixes, empty fields, control characters."""
    empty = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "")
    control = F.concat_ws(" ", "business_name", "business_address").rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")
    return records.agg(
        F.count("*").alias("rows"), empty("entity_id").alias("empty_ids"), (F.count("entity_id") - F.count_distinct("entity_id")).alias("repeated_ids"),
        F.count_if(~F.col("entity_id").startswith(F.concat("source", F.lit("-")))).alias("wrong_prefixes"),
        empty("business_name").alias("empty_names"), empty("business_address").alias("empty_addresses"), empty("country").alias("empty_countries"), F.count_if(control).alias("control_characters"),
    )


def validate_records(records: DataFrame) -> dict[str, int]:
    """The report's counts; raises InputError for empty or repeated ids and for prefixes of another source."""
    found = record_report(records).first().asDict()
    for what in ("empty_ids", "repeated_ids", "wrong_prefixes"):
        if found[what]:
            raise InputError(f"{found[what]} {what.replace('_', ' ')}")
    return found


def decision_gates(s1: DataFrame, pool: DataFrame, gold: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: whether links are exclusive, inside countries and have postal codes, how many are multiple, how many entities have none.

    Countries are compared as trimmed lower-case text.
    """
    a = s1.select(F.col("entity_id").alias("s1"), F.trim(F.lower("country")).alias("_ca"))
    b = pool.select(F.col("entity_id").alias("r"), F.trim(F.lower("country")).alias("_cb"), (F.col("postal") != "").alias("_postal"))
    links = gold.join(a, "s1").join(b, "r")
    use = gold.groupBy("r").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most")).first().most
    per = entities.select("s1").distinct().join(gold.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    shares = per.agg(F.avg((F.col("n") == 0).cast("double")).alias("singleton_rate"), F.coalesce(F.sum((F.col("n") > 1).cast("double")) / F.nullif(F.sum((F.col("n") > 0).cast("double")), F.lit(0.0)), F.lit(0.0)).alias("multi_match_share")).first()
    return links.agg(
        F.lit(use <= 1).alias("g1_exclusive"), F.coalesce(F.avg((F.col("_ca") == F.col("_cb")).cast("double")), F.lit(1.0)).alias("same_country_rate"), F.coalesce(F.avg(F.col("_postal").cast("double")), F.lit(0.0)).alias("postal_rate"),
        F.lit(shares.multi_match_share or 0.0).alias("multi_match_share"), F.lit(shares.singleton_rate or 0.0).alias("singleton_rate"),
    ).withColumns({"g2_same_country": F.col("same_country_rate") >= 0.995, "g3_postal": F.col("postal_rate") >= 0.6, "g6_multi_match": F.col("multi_match_share") >= 0.15})


def check_list_file(spark: SparkSession, path: str, header: tuple[str, str], required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(finding, n, examples): what is wrong with a result file; empty if nothing is.

    Findings: bad_header, malformed_row, repeated_row, repeated_id, self_match,
    wrong_prefix, unknown_id, missing_entity, extra_entity. `required` has s1; `valid` entity_id.
    """
    lines = spark.read.text(path)
    head = "\t".join(header)
    found = lines.where(F.col("value") == head).limit(1).collect()
    first = [] if found else lines.limit(1).collect()
    findings = [spark.createDataFrame([] if found else [("bad_header", first[0][0] if first else "")], "finding string, example string")]
    rows = lines.where(F.col("value") != head).withColumn("f", F.split("value", "\t", -1))
    good = rows.where(F.size("f") == 2).select(F.get("f", F.lit(0)).alias("s1"), F.filter(F.split(F.get("f", F.lit(1)), ","), lambda x: x != "").alias("ids"))
    say = lambda df, name, col: df.select(F.lit(name).alias("finding"), F.col(col).cast("string").alias("example"))
    findings.append(say(rows.where(F.size("f") != 2), "malformed_row", "value"))
    findings.append(say(good.groupBy("s1").count().where("count > 1"), "repeated_row", "s1"))
    findings.append(say(good.where(F.size("ids") != F.size(F.array_distinct("ids"))), "repeated_id", "s1"))
    each = good.select("s1", F.explode("ids").alias("id"))
    findings.append(say(each.where(F.col("id").startswith("S1-")), "self_match", "id"))
    findings.append(say(each.where(~F.col("id").rlike("^S[123]-")), "wrong_prefix", "id"))
    if valid is not None:
        findings.append(say(each.where(F.col("id").rlike("^S[23]-")).join(valid.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti"), "unknown_id", "id"))
    findings.append(say(required.select("s1").distinct().join(good.select("s1"), "s1", "left_anti"), "missing_entity", "s1"))
    findings.append(say(good.select("s1").join(required.select("s1"), "s1", "left_anti"), "extra_entity", "s1"))
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    ranked = out.withColumn("_n", F.row_number().over(Window.partitionBy("finding").orderBy("example")))
    return ranked.groupBy("finding").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= 5, F.col("example")))).alias("examples"))


def subset_violations(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates."""
    return matches.select("s1", "r").join(candidates.select("s1", "r"), ["s1", "r"], "left_anti")


def output_report(matches: DataFrame, candidates: DataFrame, entities: DataFrame, valid: DataFrame) -> DataFrame:
    """One row: counts of bad prefixes, unknown ids, repeated pairs and matches outside the candidates."""
    every = candidates.select("s1", "r").unionByName(matches.select("s1", "r"))
    unknown = every.join(valid.select(F.col("entity_id").alias("r")).distinct(), "r", "left_anti").count()
    repeated = sum(df.count() - df.select("s1", "r").distinct().count() for df in (matches, candidates))
    outside = subset_violations(matches, candidates).count()
    return every.agg(F.count_if(~F.col("r").rlike("^S[23]-")).alias("bad_prefixes")).withColumns({"unknown_ids": F.lit(unknown), "repeated_pairs": F.lit(repeated), "outside_candidates": F.lit(outside), "n_entities": F.lit(entities.count())})
