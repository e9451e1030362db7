"""The numbered queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakeops.llm import ann, bpe, common, decontam, lang_id, lm_score, minhash, periodic, phrases, quality, secret_scan, sharding, simhash, token_output
from lakeops.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Vocabulary file of the public tokenizers that the queries encode with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_lm_scoring(spark, sf_dir):
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


@query
def op2_sharding(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


@query
def op3_benchmark_decontamination(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_bpe_encoding(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op5_secret_scans(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query
def op6_token_id_output(spark, sf_dir):
    return token_output.materialise(table(spark, sf_dir, "documents"), scratch_path(spark, "token-shards"), tokenizer=TOKENIZER)


@query
def op7_language_id(spark, sf_dir):
    return lang_id.report(table(spark, sf_dir, "documents"))


@query
def op8_nearest_neighbours(spark, sf_dir):
    return ann.report(table(spark, sf_dir, "embeddings"))


@query
def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


@query
def op10_quality_classifier(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op11_phrase_collocations"] = phrases.ORACLE_SQL


@query
def op12_document_fingerprints(spark, sf_dir):
    return minhash.report(table(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark, sf_dir):
    return periodic.report(table(spark, sf_dir, "documents"))
