"""What the query modules share: registration, tables and pieces of DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.blocks import counted_kmers
from strandlake.kmers import kmer_text, packed_kmers
from strandlake.operators import sketch, stores
from strandlake.plans.projection import READS_SQL, reads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: K-mer length of most queries.
K = 21


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the benchmark's items: what the documents' stores are asked for."""
    return reads(spark, sf_dir, "benchmark", "item_id")


def packed(spark: SparkSession, sf_dir: str, k: int = K, canonical: bool = False) -> DataFrame:
    """(seq_no, pos, kmer) of all documents' reads."""
    return packed_kmers(reads(spark, sf_dir), k, canonical=canonical)


def counted(spark: SparkSession, sf_dir: str, k: int = K, canonical: bool = False, least: int = 1) -> DataFrame:
    """(kmer, count) of all documents' reads."""
    return counted_kmers(reads(spark, sf_dir), k, canonical, least)


def hashed(rows: DataFrame, k: int = K, *keep: str) -> DataFrame:
    """(h, *keep): a hash of packed k-mers that DuckDB shares."""
    return rows.select(sketch.portable_hash(kmer_text(F.col("kmer"), k)).alias("h"), *keep)


def hash_counts(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(h, count) of all k-mers: each is counted packed, and hashed once."""
    return hashed(counted(spark, sf_dir, k), k, "count")


#: Arrow kernel: reads -> hashes of all their k-mers, for stores and sketches that are built where reads are read.
HASHES = sketch.kmer_hashes(K)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(packed_kmers(items(spark, sf_dir), K).select("kmer").distinct())


# --- SQL

ITEMS_SQL = READS_SQL.replace("doc_id as", "item_id as").replace("from documents", "from benchmark")


def kmers_sql(k: int, reads_sql: str = READS_SQL) -> str:
    return f"""r as ({reads_sql}),
    k as (select seq_no, i - 1 as pos, substr(sequence, i, {k}) as kmer
          from (select seq_no, sequence, unnest(range(1, length(sequence) - {k - 2})) as i from r where length(sequence) >= {k}))"""


RC_SQL = "reverse(translate({}, 'ACGT', 'TGCA'))"


def hash_sql(column: str) -> str:
    """The strand-aware hash of a text."""
    step = "case c when 'A' then 16664410744025174816::ubigint when 'C' then 15956807086001210932::ubigint when 'G' then 9404339731978646439::ubigint else 836480985777824379::ubigint end"
    turn = "((h % 9223372036854775808::ubigint) * 2::ubigint + h // 9223372036854775808::ubigint)"
    return f"list_reduce(list_transform(string_split({column}, ''), lambda c: {step}), lambda h, x: xor({turn}, x))"


RUNNING_SQL = f"{kmers_sql(K)}, c as (select *, row_number() over (partition by kmer order by seq_no, pos) as n from k)"
COUNTED_SQL = f"{kmers_sql(K)}, s as (select kmer, count(*) as n from k group by kmer), c as (select k.seq_no, pos, n from k join s using (kmer))"
HASHED_SQL = f"""{kmers_sql(K)}, h as (select ('0x' || substr(md5(kmer), 1, 15))::bigint as h from k)"""
PROBES_SQL = f"p as (select distinct ('0x' || substr(md5(substr(sequence, i, {K})), 1, 15))::bigint as h from (select sequence, unnest(range(1, length(sequence) - {K - 2})) as i from ({ITEMS_SQL}) where length(sequence) >= {K}))"
