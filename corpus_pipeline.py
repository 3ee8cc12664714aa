"""The training-corpus pipeline: quality, near-dedup, decontamination, PII, encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame, whose result is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.bpe import encode_documents
from strandlake.llm.decontam import drop_contaminated
from strandlake.llm.near_dedup import drop_near_duplicates
from strandlake.llm.pii import redact_pii
from strandlake.llm.quality_model import drop_low_quality, fit_quality
from strandlake.llm.registry import table, vocabulary
from strandlake.llm.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's labelled rows, predicts to be good.

    A null text is judged as an empty one; null ids, repeated rows and ties are
    rows like others and stay or go by their texts; of an empty table nothing
    stays, without labels everything is scored by equal odds.  All columns are kept.
    """
    return drop_low_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that of the least doc_id.

    Null and empty texts have no copies; rows without an id stay; rows of one id
    stay or go together; an empty table gives no rows.  All columns are kept.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows without an id stay; an empty table gives
    no rows, an empty benchmark all.  All columns are kept.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind.

    Null texts stay null; rows are neither dropped nor joined, so nulls, repeats
    and empty tables pass.  All columns are kept.
    """
    return redact_pii(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    A null text has no tokens; null ids and repeated rows pass; an empty table gives no rows.
    """
    return encode_documents(docs, vocabulary("word_bpe_49k.json"), digests=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("encode", encode)]

#: SQL cannot express a fitted classifier; tests/llm/test_brute_force.py holds run() against plain loops on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
