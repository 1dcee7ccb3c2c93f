"""Corpus preparation as stages, each over all that its predecessor kept. A stage gets (spark, docs, sf_dir); its result is
written and read again as the next one's docs. All keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplewalk.llm import decontaminate, language_id, mixing, secrets, simhash_dedup
from triplewalk.llm.cluster import modest_batches
from triplewalk.llm.queries import MIX_SHARE, MIX_WEIGHTS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language no model accepts go, null and empty texts among them; ``lang`` stays as it was given. Languages that tie: the first
    by name. Repeated rows stay or go together. Without a row that has a doc_id, a text and a lang there is no model, and every row goes."""
    modest_batches(spark)
    return language_id.drop_rejected(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id (null last), then of the least hash of its text; of rows that
    repeat both one stays. Rows without a token all stay. No rows: none."""
    modest_batches(spark)
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; rows of null or empty text stay, repeated rows go together. An empty benchmark takes
    nothing."""
    modest_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; all documents stay, those of null or empty text as they are. Of secrets that
    start alike the longest counts."""
    modest_batches(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the budgets of their sources stay; a null source is one of its own. Rows without a word go. A repeated row is a
    further document; of rows whose hashes tie any go first, as they're alike."""
    modest_batches(spark)
    return mixing.mix(docs, weights=MIX_WEIGHTS, budget_share=MIX_SHARE)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mix_sources),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in one go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
