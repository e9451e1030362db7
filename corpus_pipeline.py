"""From raw documents to token ids: each stage's decisions shape the documents of the next.

quality classifier -> SimHash near-dedup -> benchmark decontamination -> secret scans -> BPE encoding and decoding.
Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again by the next one. A null text is
an empty document: it is scored, grouped and encoded like any other. All stages but the last return the columns given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeops.llm import bpe, common, decontam, quality, secret_scan, simhash
from lakeops.llm.queries import TOKENIZER, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    common.ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    common.ship(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    common.ship(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; the documents stay."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document left: n_tokens, ids_sha256, decoded_sha256."""
    common.ship(spark)
    return bpe.round_trip(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("bpe encoding and decoding", encode),
]

#: The classifier and the fingerprints cannot be said in SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
