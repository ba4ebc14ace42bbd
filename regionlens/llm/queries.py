"""The registered queries of this folder: each operator over its whole table, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from regionlens.llm import (
    byte_bpe, fill_in_middle, hash_ring, html_content, jaccard_join, language_id, nn_descent, packing, source_divergence, suffix_dedup, templates,
    token_counts, toxicity,
)
from regionlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.predict_languages(table(spark, folder, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicate_classes(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, folder, "embeddings"))


@query
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


@query
def op6_hash_ring(spark: SparkSession, folder: str) -> DataFrame:
    return hash_ring.shard_documents(table(spark, folder, "documents"))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.add_token_counts(table(spark, folder, "documents"))


@query
def op8_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return templates.contaminated_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op8_template_decontamination"] = templates.SQL


@query
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query
def op10_html_content(spark: SparkSession, folder: str) -> DataFrame:
    return html_content.extract(table(spark, folder, "pages"))


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, folder, "documents")))


ORACLES["op11_fill_in_middle"] = fill_in_middle.SQL


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit(table(spark, folder, "documents"))


ORACLES["op12_source_divergence"] = source_divergence.SQL


@query
def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"))))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
