"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionforge.llm import host_reputation, merkle_log, phrase_mining
from sessionforge.llm.bin_slack import pack
from sessionforge.llm.binary_codes import near_duplicate_vectors
from sessionforge.llm.bpe_transducer import round_trip
from sessionforge.llm.common import table
from sessionforge.llm.host_reputation import judge_urls
from sessionforge.llm.jaccard import jaccard_join
from sessionforge.llm.kd_shards import kd_shards
from sessionforge.llm.merkle_log import proofs
from sessionforge.llm.mixing import mix
from sessionforge.llm.ngram_bayes import toxicity_scores
from sessionforge.llm.phrase_mining import collocations
from sessionforge.llm.posting_lists import nearest
from sessionforge.llm.repeated_lines import dedup_lines
from sessionforge.llm.rule_ensemble import quality_scores


def op1_binary_code_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))


def op7_ngram_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed", "text")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


def op13_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = (op1_binary_code_dedup, op2_posting_lists, op3_host_reputation, op4_mix_sources, op5_rule_ensemble, op6_kd_shards, op7_ngram_bayes, op8_jaccard_join, op9_bin_slack, op10_repeated_lines, op11_phrase_mining, op12_merkle_log, op13_bpe_transducer)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are held against brute force in tests."""
    return {"op3_host_reputation": host_reputation.SQL, "op11_phrase_mining": phrase_mining.SQL, "op12_merkle_log": merkle_log.SQL}
