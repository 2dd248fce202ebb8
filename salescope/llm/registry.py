"""Registered queries of the training-data operators, and their SQL oracles
where SQL can express the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salescope.llm.common import table
from salescope.llm.decontaminate import flag_documents
from salescope.llm.fair_mix import mix_documents
from salescope.llm.host_reputation import judge_urls
from salescope.llm.kd_shards import shard_documents
from salescope.llm.merkle_manifest import manifest
from salescope.llm.ppm_model import score_documents
from salescope.llm.secret_automaton import secret_digest
from salescope.llm.segment_topk import top_k
from salescope.llm.shingle_join import component_of
from salescope.llm.spelling_trie import spelling_variants
from salescope.llm.sql import OP11, OP12, OP13
from salescope.llm.suffix_dedup import removal_digest
from salescope.llm.toxic_crf import score_toxicity
from salescope.llm.weak_quality import score_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op11_merkle_manifest": OP11, "op12_segment_topk": OP12,
                          "op13_spelling_trie": OP13}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


@register
def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@register
def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


@register
def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@register
def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@register
def op7_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


@register
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))


@register
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_of(table(spark, sf_dir, "documents"))


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


@register
def op12_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@register
def op13_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
