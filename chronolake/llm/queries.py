"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, embeddings, licenses, mixing, pii, quality, secrets, simhash, substrings, toxicity
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in each document: doc_id, licence, dice, n_units."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document: doc_id, held_out, score, predicted."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document: doc_id, fingerprint, component_id."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document: doc_id, held_out, score, predicted."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document: doc_id, size, source_size, target, taken."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, similarity, start, n_words."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with surrogates for personal data: doc_id, text, n_entities, n_distinct, n_surrogates."""
    return pii.anonymise(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector: vec_id, n_links, component_id, kept."""
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the text."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).withColumn("text", substrings.kept_text()).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_quality, op3_simhash, op4_toxicity, op5_mixing, op6_decontamination, op7_secrets, op8_pii, op9_embeddings, op10_suffix_dedup)}

ORACLE_SQL: dict[str, str] = {"op1_license_scan": licenses.scan_sql(), "op5_mixing": mixing.MIX_SQL}
