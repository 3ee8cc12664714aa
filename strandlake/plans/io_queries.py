"""Queries of sources, sinks and streams: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions.murmur import murmur_kmers
from strandlake.operators import sketch, windows
from strandlake.plans.common import hash_sql, kmers_sql, query, table
from strandlake.plans.projection import READS_SQL, reads
from strandlake.sources import fastx, graph_files, signatures
from strandlake.streaming import runner
from strandlake.tables import shared_path

_NAMED = f"select seq_no::varchar as name, sequence, length(sequence)::int as n from ({READS_SQL})"


@query(f"{_NAMED} where sequence <> ''")
def fasta_round_trip(spark, sf_dir):
    path = shared_path(spark, "fasta")
    fastx.write_fastx(reads(spark, sf_dir).where("sequence <> ''"), path)
    return fastx.read_fastx(spark, path).select("name", "sequence", F.length("sequence").alias("n"))


@query(f"select name, sequence, repeat('I', n) as quality from ({_NAMED}) where n >= 50")
def fastq_round_trip(spark, sf_dir):
    path = shared_path(spark, "fastq")
    fastx.write_fastx(reads(spark, sf_dir).where("sequence <> ''").withColumn("quality", F.expr("repeat('I', length(sequence))")), path, compression="gzip")
    return fastx.scan_fastx(spark, path, min_length=50, kind="fastq").where("status = 'ok'").select("name", "sequence", "quality")


@query("""with a as (select item_id, text, 'r' || item_id || case when item_id % 3 = 0 then '/1' else '' end as l, 'r' || item_id || case when item_id % 3 = 0 then '/2' when item_id % 3 = 1 then 'x' else '' end as r,
  case when item_id % 3 = 2 then '1:N:0' end as lc, case when item_id % 3 = 2 then '2:N:0' end as rc from benchmark)
select item_id, item_id % 3 <> 1 as is_pair, item_id % 3 <> 1 as is_left, item_id % 3 <> 1 as is_right from a""")
def mate_pairs(spark, sf_dir):
    i = F.col("item_id") % 3
    name = F.concat(F.lit("r"), F.col("item_id").cast("string"))
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat(name, F.when(i == 0, "/1").otherwise("")).alias("l"), F.concat(name, F.when(i == 0, "/2").when(i == 1, "x").otherwise("")).alias("r"),
        F.when(i == 2, "1:N:0").alias("lc"), F.when(i == 2, "2:N:0").alias("rc"),
    )
    l, r, lc, rc = map(F.col, ("l", "r", "lc", "rc"))
    return rows.select("item_id", fastx.is_pair(l, lc, r, rc).alias("is_pair"), fastx.is_left(l, lc).alias("is_left"), fastx.is_right(r, rc).alias("is_right"))


@query()
def minhash_signature_round_trip(spark, sf_dir):
    rows = murmur_kmers(reads(spark, sf_dir).withColumn("name", (F.col("seq_no") % 7).cast("string")), 21, keep=("name", "seq_no"))
    path = shared_path(spark, "signatures")
    signatures.write_signatures(signatures.minhash_signatures(sketch.bottom(rows, 500, "name"), 21, 500), path)
    return signatures.read_minhash_signatures(spark, path)


_HALF = f"select doc_id // 2 as pair, doc_id % 2 as side, sequence from (select seq_no as doc_id, sequence from ({READS_SQL}))"


@query(f"""with h as ({_HALF}), l as (select * from h where side = 0), r as (select * from h where side = 1)
select l.pair::bigint as seq_no, x.mate::int as mate, 'p' || l.pair || '/' || x.mate as name, case when x.mate = 1 then l.sequence else r.sequence end as sequence
from l join r on l.pair = r.pair, (select unnest([1, 2]) as mate) x where l.sequence <> '' and r.sequence <> '' and l.pair not in (select pair from h where sequence = '')""")
def mates_merged(spark, sf_dir):
    """Neighbouring documents as mates: two files, written, zipped by place with names that must match, and interleaved."""
    rows = reads(spark, sf_dir).withColumn("pair", F.floor(F.col("seq_no") / 2)).withColumn("side", F.col("seq_no") % 2)
    whole = rows.groupBy("pair").agg(F.count_if(F.col("sequence") != "").alias("n")).where("n = 2").select("pair")
    rows, sides = rows.join(whole, "pair", "left_semi"), []
    for side in (0, 1):
        path = shared_path(spark, "mates")
        name = F.concat(F.lit("p"), F.col("pair").cast("string"), F.lit(f"/{side + 1}"))
        fastx.write_fastx(rows.where(F.col("side") == side).select("pair", name.alias("name"), "sequence"), path, ("pair",))
        scan = fastx.scan_fastx(spark, path, kind="fasta", sample="s")
        # files of a folder count their records anew; names give the place in the whole
        sides.append(scan.withColumn("seq_no", F.regexp_extract("name", "[0-9]+", 0).cast("long")))
    out = fastx.interleaved(fastx.paired(*sides, strict=True, force_name_match=True))
    return out.select("seq_no", F.col("mate").cast("int").alias("mate"), "name", "sequence")


@query("""with t as (select doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as s from documents), u as (select case when length(s) = 0 then null when length(regexp_replace(s, '[ACGT]', '', 'g')) > 0 then 'skipped' when length(s) < 5 then 'skipped' else 'ok' end as st from t)
select count(*) filter (st = 'ok')::bigint as n_parsed, count(*) filter (st = 'skipped')::bigint as n_skipped from u""")
def scan_counts(spark, sf_dir):
    """Records of raw texts' letters, most of which are no nucleotides: how many a scan keeps and skips."""
    path = shared_path(spark, "raw")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_no"), letters.alias("sequence")).where("sequence <> ''")
    fastx.write_fastx(rows, path)
    return fastx.scan_counts(fastx.scan_fastx(spark, path, min_length=5, kind="fasta"))


@query(f"""with {kmers_sql(11)}, h as (select seq_no, pos, kmer, {hash_sql("kmer")} as h from k),
w as (select seq_no, min(struct_pack(h := h, pos := pos, kmer := kmer)) over (partition by seq_no order by pos rows between 9 preceding and current row) as m, row_number() over (partition by seq_no order by pos) as i from h)
select count(*)::bigint as n, count(distinct h)::bigint as n_hashes, min(h)::varchar as least, min(kmer) as kmer, sum(pos)::bigint as places from (select distinct seq_no, m.pos as pos, m.h as h, m.kmer as kmer from w where i >= 10)""")
def minimizer_csv(spark, sf_dir):
    """Minimizers of all reads, written as CSV and read back."""
    path = shared_path(spark, "minimizers")
    graph_files.minimizer_csv(windows.kmer_minimizers(reads(spark, sf_dir), 10, 11), path)
    rows = spark.read.schema("seq_no long, pos long, h decimal(20,0), kmer string").csv(path)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_hashes"), F.min("h").cast("string").alias("least"), F.min("kmer").alias("kmer"), F.sum("pos").alias("places"))


_WINDOWS = "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2"


@query(_WINDOWS)
def event_time_windows(spark, sf_dir):
    return runner.event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(_WINDOWS)
def streamed_event_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    path = shared_path(spark, "windows")
    windows = runner.event_windows(stream).writeStream.outputMode("complete").option("checkpointLocation", shared_path(spark, "stream"))
    windows.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with g as (select user_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes, true)::int as first from events),
s as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*)::bigint as n from s group by user_id, s""")
def event_sessions(spark, sf_dir):
    return runner.sessions(table(spark, sf_dir, "events"))
