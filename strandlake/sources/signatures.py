"""Sketches with their metadata as JSON lines, written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.hashing import unsigned_key, unsigned_text

PARTITION_SIGNATURE = "name string, w int, k int, size int, sketch array<bigint>, md5sum string, version string, license string"


def partition_signatures(sketches: DataFrame, w: int, k: int, name: str = "name") -> DataFrame:
    """Signatures of (name, sketch) rows; md5sum is of the sketch's decimal values joined by commas."""
    digest = F.md5(F.array_join(F.transform("sketch", lambda x: x.cast("string")), ",").cast("binary"))
    return sketches.select(
        F.col(name).cast("string").alias("name"), F.lit(w).alias("w"), F.lit(k).alias("k"), F.size("sketch").alias("size"), "sketch", digest.alias("md5sum"),
        F.lit("1.0").alias("version"), F.lit("CC0").alias("license"),
    )


def minhash_signatures(hashes: DataFrame, k: int, num: int = 0, max_hash: int = 0, seed: int = 42, name: str = "name") -> DataFrame:
    """(name, signature) of (name, h, abundance) rows of bounded sketches: the public MinHash JSON layout."""
    mins = F.array_sort(F.collect_list(F.struct(unsigned_key(F.col("h")).alias("o"), F.col("h"), F.col("abundance"))))
    rows = hashes.groupBy(F.col(name).cast("string").alias("name")).agg(mins.alias("m"))
    texts = F.transform("m", lambda x: unsigned_text(x["h"]))
    digest = F.md5(F.concat(F.lit(str(k)), F.array_join(texts, "")).cast("binary"))
    # unsigned 64-bit numbers have no SQL type that JSON writes bare, so the list is joined as text
    body = F.concat(
        F.lit(f'[{{"num":{num},"ksize":{k},"seed":{seed},"max_hash":{max_hash},"mins":['), F.array_join(texts, ","), F.lit('],"abundances":['),
        F.array_join(F.transform("m", lambda x: x["abundance"].cast("string")), ","), F.lit('],"md5sum":"'), digest, F.lit('","molecule":"DNA"}]'),
    )
    head = F.to_json(F.struct(F.lit("sourmash_signature").alias("class"), F.lit("0.murmur64").alias("hash_function"), F.lit("CC0").alias("license"), F.lit(0.4).alias("version"), "name"))
    return rows.select("name", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"signatures":'), body, F.lit("}")).alias("signature"))


def write_signatures(signatures: DataFrame, path: str) -> None:
    """JSON lines; a ``signature`` text is written as it is."""
    text = F.col("signature") if "signature" in signatures.columns else F.to_json(F.struct(*signatures.columns))
    signatures.select(text.alias("value")).write.text(path)


def read_partition_signatures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTITION_SIGNATURE).json(path)


def read_minhash_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(name, ksize, num, max_hash, md5sum, h, abundance), a row for each hash."""
    part = "num long, ksize int, seed long, max_hash decimal(20,0), mins array<decimal(20,0)>, abundances array<long>, md5sum string, molecule string"
    rows = spark.read.schema(f"name string, signatures array<struct<{part.replace(' ', ':').replace(',:', ',')}>>").json(path)
    rows = rows.select("name", F.explode("signatures").alias("s")).select("name", "s.ksize", "s.num", "s.max_hash", "s.md5sum", F.posexplode("s.mins").alias("i", "m"), "s.abundances")
    wrapped = F.when(F.col("m") >= F.expr("9223372036854775808BD"), F.col("m") - F.expr("18446744073709551616BD")).otherwise(F.col("m")).cast("long")
    return rows.select("name", "ksize", "num", "max_hash", "md5sum", wrapped.alias("h"), F.get("abundances", F.col("i")).alias("abundance"))
