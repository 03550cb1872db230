"""Queries that apply the corpus operators to whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import table
from sluice.llm.mixing import Mixture
from sluice.llm.sql import license_diagonals, mixing


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.rule_ensemble import fit, score

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out), "quality")
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.severity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), "toxic")).select("doc_id", "severity", "grade", "score", "predicted")


def op2_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.diagonals import scan, summary

    return summary(scan(table(spark, sf_dir, "documents")))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.token_binary import token_file
    from sluice.llm.token_ids import default_tokenizer

    return token_file(table(spark, sf_dir, "documents"), default_tokenizer())


def op4_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.prefix_hash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op6_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.secrets import digest

    return digest(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.near_dedup import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.audio import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def with_domain(docs: DataFrame) -> DataFrame:
    """The tables name no domain: sources are dealt to four by a hash of their names. A column domain stays what it is."""
    if "domain" in map(str.lower, docs.columns):
        return docs
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1
    return docs.withColumn("domain", F.concat(F.lit("domain"), (digit % 4).cast("string")))


#: What op9_mixing mixes to.
MIXTURE = Mixture(weights={"domain": {"domain0": 2.0}, "lang": {"en": 4.0, "de": 2.0}}, share=0.6, max_epochs=2, seed=17)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.mixing import mix, words_and_end

    mixed = mix(with_domain(table(spark, sf_dir, "documents")), MIXTURE)
    return mixed.select("doc_id", "domain", "lang", "source", words_and_end(F.coalesce("text", F.lit(""))).alias("tokens"), F.col("_epoch").alias("epoch"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.packing import pack
    from sluice.llm.token_ids import default_tokenizer

    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_diagonals": op2_license_diagonals,
    "op3_token_binary": op3_token_binary,
    "op4_prefix_fingerprints": op4_prefix_fingerprints,
    "op5_toxicity_severity": op5_toxicity_severity,
    "op6_secret_randomness": op6_secret_randomness,
    "op7_near_dedup": op7_near_dedup,
    "op8_audio_features": op8_audio_features,
    "op9_mixing": op9_mixing,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op2_license_diagonals": license_diagonals(), "op9_mixing": mixing(MIXTURE)}
