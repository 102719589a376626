"""A corpus pipeline over documents: each stage works on all that the one before kept.

Toxic documents go, then those whose language stays undetermined; of each group of
near copies the row with the smallest id stays, once; documents that hold a benchmark
passage go; the rest are encoded to token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontaminate, langid, simhash, toxicity
from corpusmill.runtime import Scratch

#: Toxic from this score on: the operator's own threshold, at which recall and false positives are measured.
TOXIC = 0.3
#: A document's language is undetermined below this winning probability.
MIN_LANGUAGE_SCORE = 0.25
#: Fingerprints that differ in at most so many of 64 bits are near copies.
RADIUS = 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity models, fitted on the labelled ones, score at TOXIC or more.

    Every row is judged by its own text, whatever its id.
    """
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_of(spark, F.col("text"), model) < TOXIC)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language, each row by its own text."""
    found = langid.prediction_of(spark, F.col("text"), langid.fit(docs))
    return docs.filter((found["lang_pred"] != langid.UNDETERMINED) & (found["score"] >= MIN_LANGUAGE_SCORE))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest doc_id, null last, and of its texts that with the smallest hash.

    Rows are told apart by all their columns, so rows that share an id, or have none, are
    grouped by their texts like any other, and only repeats of a whole row are one.
    """
    keyed = docs.withColumn("_row", F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]))
    groups = simhash.near_duplicate_groups(keyed, id_col="_row", radius=RADIUS, words_per_shingle=3).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row")))
    kept = keyed.select("_row", "doc_id").distinct().join(groups, "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def keep_clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, edited or not, each row by its own text."""
    return docs.filter(~decontaminate.holds_item(F.col("text"), decontaminate.seeds(docs, _table(spark, sf_dir, "benchmark"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, checked by decoding."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", keep_civil),
    ("language", keep_known_language),
    ("simhash", keep_one_of_each_group),
    ("decontamination", keep_clean_of_benchmarks),
    ("bpe", encode),
]

#: No stage can be expressed in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again.

    A stage's table is removed when the next one is written.
    """
    scratch, before = Scratch(spark, "pipeline"), None
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
