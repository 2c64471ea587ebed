"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlint.llm import (
    bpe, centroids, infilling, mixing, packing, pii, quality, repeats, simhash, tokenfile, toxicity, vectors, warc)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(table(spark, sf_dir, "documents"))


def op3_quality_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_digest(table(spark, sf_dir, "embeddings"))


def op7_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op8_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op11_heap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(table(spark, sf_dir, "embeddings"))


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.infill_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_repeated_strings, op3_quality_list, op4_mix, op5_bpe_automaton, op6_embedding_cells,
    op7_pii_contexts, op8_simhash_balls, op9_toxicity, op10_warc_derivatives,
    op11_heap_centroids, op12_slack_packing, op13_infilling)}

SQL: dict[str, str] = {"op11_heap_centroids": centroids.cluster_sql(), "op13_infilling": infilling.infill_sql()}
