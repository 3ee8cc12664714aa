"""Queries of the training-data operators, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.bpe import encode_documents
from strandlake.llm.compaction import shard_documents
from strandlake.llm.decontam import contaminated
from strandlake.llm.near_dedup import near_duplicates
from strandlake.llm.oracles import WARC_SQL, near_duplicates_sql, pii_sql
from strandlake.llm.pii import pii_digest
from strandlake.llm.quality_model import fit_quality, score_quality
from strandlake.llm.quality_rules import quality_rules, rules_sql
from strandlake.llm.suffix_dedup import repeated_substrings
from strandlake.llm.token_store import token_store_round_trip
from strandlake.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digests=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_warc,
        op3_token_store,
        op4_bpe,
        op5_quality_rules,
        op6_pii,
        op7_decontamination,
        op8_suffix_dedup,
        op9_sharding,
        op10_near_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": WARC_SQL,
    "op5_quality_rules": rules_sql(),
    "op6_pii": pii_sql(),
    "op10_near_dedup": near_duplicates_sql(),
}
