"""From documents to packed sequences: the stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import mixing, near_dedup, secrets, severity
from sluice.llm.common import release, table, written, written_so_far
from sluice.llm.packing import pack
from sluice.llm.queries import with_domain
from sluice.llm.token_ids import default_tokenizer


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is over the model's cut go."""
    model = severity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return severity.score(docs, model).where("predicted = 0").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the least doc_id."""
    return near_dedup.dedup(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, their secrets masked."""
    return secrets.redact(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the corpus by bytes, which the packed tokens follow, shared by weights; what was just freed of copies
    isn't repeated, so one epoch at most."""
    mixture = mixing.Mixture(weights={"lang": {"en": 4.0, "de": 2.0}}, share=0.9, max_epochs=1, seed=17)
    return mixing.mix(with_domain(docs), mixture, mixing.bytes_and_end, epoch=None).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Learned models, weighted samples and tokenizers aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, docs, before)  # what this stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
