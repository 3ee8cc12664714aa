"""Deterministic nucleotide reads from the text table, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.tables import spread

#: Letters of the Latin alphabet and the nucleotides they stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[:26]

READS_SQL = f"""select doc_id as seq_no, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') as sequence from documents"""


def reads(spark: SparkSession, sf_dir: str, table: str = "documents", number: str = "doc_id") -> DataFrame:
    """(seq_no, sequence) of every text: its letters a-z as nucleotides."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(number).alias("seq_no"), "text")
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return spread(rows).select("seq_no", F.translate(letters, LETTERS, BASES).alias("sequence"))
