"""From documents to token ids: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents.

language         documents in none of the known languages go (no letter at all, or no language ahead of the others)
near_dedup       one document of each near-duplicate group stays, the one with the smallest id
decontaminate    documents that copy a benchmark item go
secrets          documents stay; secrets in their texts are masked, and n_chars follows
sentencepiece    ids, n_tokens and round_trip are added

A null text goes at the first stage. A null doc_id stays to the end. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, language_id, near_dedup, secrets, sentencepiece
from colloquy.llm._shared import checkpoint, ready

#: Of four languages, one that no word speaks for has a score of 0.25.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    found = language_id.identify(docs, language_id.train(docs))
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepiece.tokenize(docs, sentencepiece.Pieces())
    return out.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [("language", language), ("near_dedup", deduplicate), ("decontaminate", clean_of_benchmark), ("secrets", mask_secrets), ("sentencepiece", encode)]

#: SQL can express neither the language model nor the forest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
