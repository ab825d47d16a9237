"""Readers and writers of business records, links and matching results.

Record files are tab-separated without quoting: a quote is text, and so are NA
and None. The empty string marks a missing value; nothing is ever null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
LINKS = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
MATCHING_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


class HeaderError(ValueError):
    """A file's header is not the expected one."""


def _place(path: str) -> list:
    """A sort key of files: numbers in a path by value, as part-99999 comes before part-100000."""
    return [int(x) if i % 2 else x for i, x in enumerate(re.split("([0-9]+)", path))]


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, malformed: str = "keep") -> DataFrame:
    """A tab-separated file as strings, in file order by the column `row_ord`.

    `columns` is the header that must be there, to the letter (in a folder of part
    files, in one of them). Rows with fewer
    fields are filled up (`keep`), left out (`drop`) or end the read (`fail`). A
    byte-order mark is ignored. row_ord rises with the place in the file, and over a
    folder's files by name; it comes from the place itself, so a lost task gives the
    same numbers again.
    """
    bare = F.regexp_replace("value", "^﻿|\r$", "")
    # Spark deals the parts of files to tasks by size, so a task's number says nothing about the order: the parts are numbered here.
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    text = spark.read.text(path).select("value", *block, F.monotonically_increasing_id().alias("_id"))
    seen = F.max(bare == "\t".join(columns)) if columns is not None else F.lit(None).cast("boolean")
    found = text.groupBy("_file", "_start").agg(seen.alias("headed"), *([] if columns is not None else [F.min_by(bare, "_id").alias("line")])).collect()
    blocks = sorted(found, key=lambda b: (_place(b._file), b._start))
    if columns is None:
        header = tuple(blocks[0].line.split("\t")) if blocks else ()
    else:
        header = tuple(columns)
        if not any(b.headed for b in blocks):
            raise HeaderError(f"{path}: no header {header}, but {[r[0] for r in spark.read.text(path).limit(1).collect()]}")
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    numbers = spark.createDataFrame([(b._file, b._start, i) for i, b in enumerate(blocks)], "_file string, _start long, _nth long")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    lines = text.where("value <> ''").join(numbers, ["_file", "_start"]).select("value", (F.shiftleft("_nth", 33) + inside).alias("row_ord"))
    rows = lines.select(parts.alias("f"), "row_ord", bare.alias("line")).where(F.col("line") != "\t".join(header)).drop("line")
    if malformed == "drop":
        rows = rows.where(F.size("f") >= len(header))
    elif malformed == "fail":
        rows = rows.where(F.when(F.size("f") == len(header), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{path}: a row with another number of fields: "), F.array_join("f", "|"))).cast("boolean")))
    return rows.select(*(F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(header)), "row_ord")


def read_records(spark: SparkSession, path: str, source: str, split: str = "train", malformed: str = "keep") -> DataFrame:
    """Business records with `source` (S1, S2, S3) and `split`."""
    return read_tsv(spark, path, RECORD.names, malformed).withColumns({"source": F.lit(source), "split": F.lit(split)})


def read_links(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities: s1, row_ord; gold: s1, r): every entity, with or without links, and one row per link."""
    rows = read_tsv(spark, path, LINKS.names)
    entities = rows.select(F.col("source1_entity_id").alias("s1"), "row_ord")
    return entities, rows.select(F.col("source1_entity_id").alias("s1"), F.explode(id_list(F.col("matched_entity_ids"))).alias("r"))


def id_list(text: Column) -> Column:
    """The ids of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def pool(second: DataFrame, third: DataFrame) -> DataFrame:
    """The records to match against: both sources, with is_s3."""
    return second.withColumn("is_s3", F.lit(0)).unionByName(third.withColumn("is_s3", F.lit(1)))


def write_normalised(records: DataFrame, path: str) -> None:
    """Parquet by split, source and country, which prunes later reads."""
    records.write.mode("overwrite").partitionBy("split", "source", "country_norm").parquet(path)


def read_normalised(spark: SparkSession, path: str, split: str | None = None, sources: Sequence[str] | None = None, country: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if sources is not None:
        df = df.where(F.col("source").isin(*sources))
    if country is not None:
        df = df.where(F.col("country_norm") == country)
    return df.select(*columns) if columns else df


class ContractError(ValueError):
    """Results that break the output contract."""


def as_lists(entities: DataFrame, pairs: DataFrame, header: Sequence[str]) -> DataFrame:
    """One row per entity in its order: id and its ids r, each once, in the order of `ord` if there is one."""
    order = F.col("ord") if "ord" in pairs.columns else F.col("r")
    once = pairs.groupBy("s1", "r").agg(F.min(order).alias("o"))
    lists = once.groupBy(F.col("s1").alias("_s1")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]), ",").alias("ids"))
    return entities.join(lists, F.col("s1") == F.col("_s1"), "left").select(F.col("s1").alias(header[0]), F.coalesce("ids", F.lit("")).alias(header[1]), "row_ord")


def check_output(entities: DataFrame, candidates: DataFrame, matches: DataFrame, valid: DataFrame | None = None) -> None:
    """Raise ContractError for repeated entities, ids that are not S2- or S3-, unknown ids, or matches outside the candidates."""
    twice = entities.groupBy("s1").count().where("count > 1").limit(5).collect()
    if twice:
        raise ContractError(f"repeated entities: {[r.s1 for r in twice]}")
    every = candidates.select("s1", "r").unionByName(matches.select("s1", "r"))
    bad = every.where(~F.col("r").rlike("^S[23]-")).limit(5).collect()
    if bad:
        raise ContractError(f"ids of another source: {[r.r for r in bad]}")
    if valid is not None:
        unknown = every.select("r").distinct().join(valid.select(F.col("entity_id").alias("r")), "r", "left_anti").limit(5).collect()
        if unknown:
            raise ContractError(f"unknown ids: {[r.r for r in unknown]}")
    outside = matches.select("s1", "r").join(candidates.select("s1", "r"), ["s1", "r"], "left_anti").limit(5).collect()
    if outside:
        raise ContractError(f"matches that are no candidates: {[(r.s1, r.r) for r in outside]}")


def write_results(entities: DataFrame, candidates: DataFrame, matches: DataFrame, path: str, valid: DataFrame | None = None) -> None:
    """`matching_results` and `candidate_pairs` under `path`, as tab-separated text in the entities' order."""
    check_output(entities, candidates, matches, valid)
    for name, pairs, header in (("matching_results", matches, MATCHING_HEADER), ("candidate_pairs", candidates, CANDIDATE_HEADER)):
        lines = as_lists(entities, pairs, header).orderBy("row_ord").select(F.concat_ws("\t", *header).alias("value"))
        head = entities.sparkSession.createDataFrame([("\t".join(header),)], "value string")
        head.coalesce(1).union(lines).write.mode("overwrite").text(f"{path}/{name}")


def distinct_gather(df: DataFrame, columns: Sequence[str], apply) -> DataFrame:
    """Compute `apply` on the distinct values of `columns` and join the results back."""
    return df.join(apply(df.select(*columns).distinct()), list(columns))


def keyed_sample(pairs: DataFrame, keep: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All rows of `pairs` (entity_id ...) in `keep`, and the n others with the least hash: a reproducible sample."""
    kept = pairs.join(keep.select("entity_id").distinct(), "entity_id", "left_semi")
    rest = pairs.join(keep.select("entity_id").distinct(), "entity_id", "left_anti")
    return kept.unionByName(rest.orderBy(F.xxhash64(F.lit(seed), "entity_id"), "entity_id").limit(n))


def cohort(entities: DataFrame, gold: DataFrame, pool_records: DataFrame, n_val: int, n_train: int, n_distractors: int) -> dict[str, DataFrame]:
    """Validation and training cohorts: the first n_val entities, the next n_train, their gold records, and
    the first distractors in file order, half to each."""
    from pyspark.sql.window import Window

    ranked = entities.orderBy("row_ord").limit(n_val + n_train).withColumn("n", F.row_number().over(Window.orderBy("row_ord")))
    val, train = ranked.where(F.col("n") <= n_val).drop("n"), ranked.where(F.col("n") > n_val).drop("n")
    linked = gold.select(F.col("r").alias("entity_id")).distinct()
    free = pool_records.join(linked, "entity_id", "left_anti").orderBy("row_ord").limit(n_distractors).withColumn("n", F.row_number().over(Window.orderBy("row_ord")))
    half = n_distractors // 2
    out = {}
    for name, part, rest in (("val", val, free.where(F.col("n") <= half)), ("train", train, free.where(F.col("n") > half))):
        own = gold.join(part.select("s1"), "s1", "left_semi")
        out[f"{name}_entities"], out[f"{name}_gold"] = part, own
        out[f"{name}_pool"] = pool_records.join(own.select(F.col("r").alias("entity_id")).distinct(), "entity_id", "left_semi").unionByName(rest.drop("n"))
    return out


def countries(records: DataFrame) -> DataFrame:
    """(country_norm, n) of the countries that are given, the most frequent first."""
    return records.where("country_norm <> ''").groupBy("country_norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_norm")


def package(paths: Sequence[str], archive: str) -> None:
    """Pack files and folders on the driver into a zip archive, by their base names."""
    import zipfile
    from pathlib import Path

    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in map(Path, paths):
            for f in sorted(p.rglob("*")) if p.is_dir() else [p]:
                if f.is_file() and not f.name.startswith("."):
                    z.write(f, f.relative_to(p.parent))
