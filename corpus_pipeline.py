"""A training-corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns documents; run() writes each
result as Parquet in the cluster's shared folder and reads it again as the next
stage's input, so a lost executor repeats part of one stage only.

All stages treat rows alike: columns other than those that a stage names pass
through unread and unchanged, whatever their names; a null text counts as an
empty one; texts of any length are read whole; an empty table gives an empty
one with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from entwine.llm import bpe, mixing, ngram_join, quality, toxicity
from entwine.llm.common import disguised, scratch, table
from entwine.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from the labels outside the held-out fold.

    A document at 0.5 exactly goes. Null and empty texts have the score of one
    empty sentence and stay. Repeated rows are judged one by one, alike.
    """
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    rows, name = disguised(docs)
    kept = toxicity.score(rows, model, text_col=name["text"], spans=False).where("predicted = 0")
    return kept.select(*rows.columns).toDF(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their language's and source's adaptive fences.

    Null and empty texts have fewer than 50 words and go. A value on a fence
    passes. Null languages and sources are groups of their own. Repeated rows are
    judged one by one, alike.
    """
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar ones: that with the smallest doc_id.

    A similarity of 0.8 exactly is a link. Rows with one doc_id are one document,
    so of repeated rows one stays. Texts without words and rows without an id
    are like no other and stay.
    """
    return ngram_join.first_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix to target weights begins it.

    Texts without words are never begun. The order of a source is that of a
    hash, with ties by id; rows that are repeated are rows of their own in it.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's id, number of tokens, token ids and the digests of ids and decoded text.

    Null and empty texts have no tokens; repeated rows are encoded one by one; other columns are left out.
    """
    return bpe.encode_decode(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: Not expressible in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`. A stage's folder is deleted once the next one is written; the last one stays."""
    folder = f"{scratch(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
