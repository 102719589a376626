"""The operators of this subpackage as registered queries over the standard tables, and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import boilerplate, bpe, covertree, decontaminate, langid, ngram_lm, simhash, tokenfile, toxicity, warc
from corpusmill.runtime import Scratch


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(_fold(4) != 2))
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", (_fold(4) == 2).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(_fold(5) != 0))
    return langid.predict(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    archives = warc.write(_t(spark, sf_dir, "pages"), scratch)
    return warc.read(spark, archives, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract(_t(spark, sf_dir, "pages"))


def op5_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.links(_t(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(_t(spark, sf_dir, "documents"), radius=2, words_per_shingle=3)
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_t(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    folder, shards = ngram_lm.train(docs.filter(_fold(7) != 2), Scratch(spark, "op9"))
    scores = ngram_lm.score(docs, folder, shards)
    return scores.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op10")
    path, dictionary = tokenfile.write_token_files(_t(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch=scratch)
    return tokenfile.positions(tokenfile.read_token_files(spark, path, dictionary), scratch)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language, op3_warc, op4_main_text, op5_covertree, op6_simhash, op7_decontaminate, op8_bpe, op9_ngram_lm, op10_token_files)}

#: None of the ten can be expressed in SQL (hashes, models or formats); tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {}
