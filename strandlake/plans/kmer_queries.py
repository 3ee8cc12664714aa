"""Queries of k-mers, alphabets, hashes, counts and read filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import hashing, murmur, protein
from strandlake.functions.alphabet import ANY, DNA, DNAN, IUPAC
from strandlake.functions.hashing import hash_expression, hashed_kmers, packed_hash_expression, unsigned_min, unsigned_text
from strandlake.kmers import kmer_text, packed_kmers
from strandlake.operators import filters, stores
from strandlake.plans.common import COUNTED_SQL, K, RC_SQL, RUNNING_SQL, counted, hash_sql, items, kmers_sql, packed, query, table
from strandlake.plans.common import ITEMS_SQL
from strandlake.plans.projection import LETTERS, READS_SQL, reads


@query(f"""with {kmers_sql(K)}, c as (select kmer, count(*) as n from k group by kmer)
select count(*)::bigint as n_unique, count(*) filter (n >= 2)::bigint as n_solid, sum(n)::bigint as n_kmers from c""")
def kmer_summary(spark, sf_dir):
    return counted(spark, sf_dir).agg(F.count("*").alias("n_unique"), F.count_if(F.col("count") >= 2).alias("n_solid"), F.sum("count").alias("n_kmers"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_summary(spark, sf_dir)


@query(f"""with {kmers_sql(K)} select n as abundance, count(*)::bigint as n_kmers from (select count(*)::bigint as n from k group by kmer) group by n""")
def kmer_histogram(spark, sf_dir):
    return counted(spark, sf_dir).groupBy(F.col("count").alias("abundance")).agg(F.count("*").alias("n_kmers"))


@query(f"""with {kmers_sql(11)}, c as (select least(kmer, {RC_SQL.format("kmer")}) as c from k)
select n as abundance, count(*)::bigint as n_kmers from (select count(*)::bigint as n from c group by c) group by n""")
def canonical_kmer_histogram(spark, sf_dir):
    rows = counted(spark, sf_dir, 11, canonical=True)
    return rows.groupBy(F.col("count").alias("abundance")).agg(F.count("*").alias("n_kmers"))


@query(f"with r as ({READS_SQL}) select seq_no, {RC_SQL.format('sequence')} as rc from r")
def reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("seq_no", DNA.reverse_complement(F.col("sequence")).alias("rc"))


_UPPER = f"translate(text, '{LETTERS}', '{LETTERS.upper()}')"


@query(f"""with t as (select doc_id, {_UPPER} as u from documents) select doc_id, u = regexp_replace(u, '[^ACGT]', '', 'g') as dna, u = regexp_replace(u, '[^ACGTN]', '', 'g') as dnan,
  u = regexp_replace(u, '[^{IUPAC.symbols}]', '', 'g') as iupac, u is not null as "any", translate(u, '{IUPAC.symbols}', '{IUPAC.complements}') as complement from t""")
def alphabet_validation(spark, sf_dir):
    text = F.col("text")
    upper = F.translate(text, LETTERS, LETTERS.upper())
    valid = [a.is_valid(text).alias(a.name.lower()) for a in (DNA, DNAN, IUPAC)]
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", *valid, (text.isNotNull() & ANY.is_valid(text)).alias("any"), IUPAC.complement(upper).alias("complement"))


@query(f"""with {kmers_sql(27)}, h as (select seq_no, pos, {hash_sql("kmer")} as fw, {hash_sql(RC_SQL.format("kmer"))} as rc from k)
select seq_no, count(*)::bigint as n, min(fw)::varchar as least_fw, max(rc)::varchar as most_rc, min(least(fw, rc))::varchar as least_h, bit_xor(fw)::varchar as all_fw, bit_xor(rc)::varchar as all_rc,
  bit_xor(least(fw, rc))::varchar as all_h, count(*) filter (fw < rc)::bigint as n_forward from h group by seq_no""")
def cyclic_hashes(spark, sf_dir):
    """Both hashes and the lesser of every k-mer, summed up for each read."""
    rows = hashed_kmers(reads(spark, sf_dir), 27)
    key, text = hashing.unsigned_key, lambda c: unsigned_text(c)
    least = lambda c: text(key(F.min(key(F.col(c)))))
    most = lambda c: text(key(F.max(key(F.col(c)))))
    every = [text(F.bit_xor(c)).alias(f"all_{c}") for c in ("fw", "rc", "h")]
    forward = F.count_if(hashing.canonical(F.col("fw"), F.col("rc"))["sign"]).alias("n_forward")
    return rows.groupBy("seq_no").agg(F.count("*").alias("n"), least("fw").alias("least_fw"), most("rc").alias("most_rc"), least("h").alias("least_h"), *every, forward)


@query(f"""with {kmers_sql(27, ITEMS_SQL)} select seq_no, pos, {hash_sql("kmer")}::varchar as fw, {hash_sql(RC_SQL.format("kmer"))}::varchar as rc from k""")
def probe_hashes(spark, sf_dir):
    """Every hash of the items that are looked up."""
    return hashed_kmers(items(spark, sf_dir), 27).select("seq_no", "pos", unsigned_text(F.col("fw")).alias("fw"), unsigned_text(F.col("rc")).alias("rc"))


@query(f"""with {kmers_sql(27)} select seq_no, count(*)::bigint as n, bit_xor({hash_sql("kmer")})::varchar as all_fw from k group by seq_no""")
def cyclic_hash_expression(spark, sf_dir):
    rows = packed(spark, sf_dir, 27).select("seq_no", packed_hash_expression(F.col("kmer"), 27).alias("fw"))
    return rows.groupBy("seq_no").agg(F.count("*").alias("n"), unsigned_text(F.bit_xor("fw")).alias("all_fw"))


_SYMBOLS = "(select unnest(['A', 'C', 'G', 'T']) as s)"


@query(f"""with {kmers_sql(15, ITEMS_SQL)}, d as (select distinct kmer from k), e as (select kmer, 'right' as side, s as symbol, substr(kmer, 2) || s as near from d, {_SYMBOLS} union all select kmer, 'left', s, s || substr(kmer, 1, 14) from d, {_SYMBOLS})
select kmer, side, symbol, {hash_sql("near")}::varchar as h, least({hash_sql("near")}, {hash_sql(RC_SQL.format("near"))})::varchar as canonical_h from e""")
def hash_extensions(spark, sf_dir):
    """The eight neighbours' hashes of each probe, rolled from the k-mer's own hash."""
    rows = packed_kmers(items(spark, sf_dir), 15).select(kmer_text(F.col("kmer"), 15).alias("kmer")).distinct()
    rows = rows.select("kmer", hash_expression(F.col("kmer"), 15).alias("fw"), hash_expression(DNA.reverse_complement(F.col("kmer")), 15).alias("rc"))
    sides = [hashing.hashed_extensions(F.col("kmer"), F.col("fw"), F.col("rc"), 15, side) for side in ("left", "right")]
    out = rows.select("kmer", F.explode(F.concat(*sides)).alias("x")).select("kmer", "x.side", "x.symbol", "x.fw", "x.rc")
    return out.select("kmer", "side", "symbol", unsigned_text(F.col("fw")).alias("h"), unsigned_text(unsigned_min(F.col("fw"), F.col("rc"))).alias("canonical_h"))


@query(f"""with {kmers_sql(14, ITEMS_SQL)}, d as (select distinct kmer from k)
select kmer, {hash_sql("kmer || 'G'")}::varchar as extended, {hash_sql("'G' || kmer")}::varchar as prepended, {hash_sql("substr(kmer, 2)")}::varchar as shrunk from d""")
def hash_lengths(spark, sf_dir):
    """Hashes of k-mers one symbol longer, at either end, and one shorter, from the k-mer's own."""
    rows = packed_kmers(items(spark, sf_dir), 14).select(kmer_text(F.col("kmer"), 14).alias("kmer")).distinct()
    h = hash_expression(F.col("kmer"), 14)
    out = [hashing.extended(h, F.lit("G")), hashing.prepended(h, F.lit("G"), 14), hashing.without_first(h, F.substring("kmer", 1, 1), 14)]
    return rows.select("kmer", *[unsigned_text(c).alias(n) for c, n in zip(out, ("extended", "prepended", "shrunk"), strict=True)])


def _murmur_sql(column: str, source: str) -> str:
    """Steps of the published 64-bit hash of a 21-symbol text, in unsigned arithmetic modulo 2**64: m1 to m6, of which m6 has (kmer, h)."""
    top = "18446744073709551616::uhugeint"
    mul = lambda a, b: f"(({a})::uhugeint * {b}::uhugeint % {top})::ubigint"
    add = lambda a, b: f"((({a})::uhugeint + ({b})::uhugeint) % {top})::ubigint"
    turn = lambda x, by: f"({mul(x, 1 << by)} + ({x}) // {1 << (64 - by)}::ubigint)"
    c1, c2 = int(murmur.C1), int(murmur.C2)
    first = lambda k: mul(turn(mul(k, c1), 31), c2)
    second = lambda k: mul(turn(mul(k, c2), 33), c1)
    word = lambda a, n: " + ".join(f"ascii(substr({column}, {a + i + 1}, 1))::ubigint * {1 << 8 * i}::ubigint" for i in range(n))
    shift = f"{1 << 33}::ubigint"

    def mixed(x: str) -> str:
        return f"xor({x}, ({x}) // {shift})"

    m_1, m_2 = (int(m) for m in (murmur.M1, murmur.M2))
    return f"""m1 as (select {column} as kmer, {word(0, 8)} as k1, {word(8, 8)} as k2, {word(16, 5)} as k3 from {source}),
    m2 as (select *, {add(mul(add(turn(f"xor({murmur.SEED}::ubigint, {first('k1')})", 27), f"{murmur.SEED}::ubigint"), 5), f"{int(murmur.A1)}::ubigint")} as h1 from m1),
    m3 as (select *, {add(mul(add(turn(f"xor({murmur.SEED}::ubigint, {second('k2')})", 31), "h1"), 5), f"{int(murmur.A2)}::ubigint")} as h2 from m2),
    m4 as (select kmer, xor(xor(h1, {first('k3')}), 21::ubigint) as a, xor(h2, 21::ubigint) as b from m3),
    m5 as (select kmer, {add("a", "b")} as x, {add(add("a", "b"), "b")} as y from m4),
    m5a as (select kmer, {mul(mixed("x"), m_1)} as x, {mul(mixed("y"), m_1)} as y from m5), m5b as (select kmer, {mul(mixed("x"), m_2)} as x, {mul(mixed("y"), m_2)} as y from m5a),
    m6 as (select kmer, {add(mixed("x"), mixed("y"))} as h from m5b)"""


@query(f"""with {kmers_sql(K)}, c as (select seq_no, least(kmer, {RC_SQL.format("kmer")}) as kmer from k), e as (select distinct kmer from c), {_murmur_sql("kmer", "e")}
select seq_no, count(*)::bigint as n, min(h)::varchar as least, max(h)::varchar as most, bit_xor(h)::varchar as all_h from c join m6 using (kmer) group by seq_no""")
def murmur_hashes(spark, sf_dir):
    """The exchange hash of every k-mer, of the lesser strand, summed up for each read."""
    key = hashing.unsigned_key
    rows = murmur.murmur_kmers(reads(spark, sf_dir), K)
    ends = [unsigned_text(key(f(key(F.col("h"))))).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))]
    return rows.groupBy("seq_no").agg(F.count("*").alias("n"), *ends, unsigned_text(F.bit_xor("h")).alias("all_h"))


_CODE = "strpos('TCAG', substr(c, 1, 1)) * 16 + strpos('TCAG', substr(c, 2, 1)) * 4 + strpos('TCAG', substr(c, 3, 1)) - 20"


@query(f"""with c as (select seq_no, list_transform(range(0, length(sequence) // 3), lambda i: substr(sequence, (3 * i + 1)::int, 3)) as cs from ({READS_SQL})),
r as (select seq_no, array_to_string(list_transform(cs, lambda c: substr('{protein.RESIDUES}', ({_CODE})::int, 1)), '') as residues from c)
select seq_no, case when cs is not null then coalesce(residues, '') end as residues, case when cs is not null then translate(coalesce(residues, ''), 'CAGPSTDENQHKRILMVFWY', 'abbbbbccccdddeeeefff') end as dayhoff from r join c using (seq_no)""")
def codon_translation(spark, sf_dir):
    residues = protein.translate_sequence(F.col("sequence"))
    return reads(spark, sf_dir).select("seq_no", residues.alias("residues"), protein.dayhoff(residues).alias("dayhoff"))


# --- counts and filters


@query(f"with {RUNNING_SQL} select seq_no, count(*)::bigint as n_kmers, max(n)::bigint as most, count(*) filter (n = 1)::bigint as n_new from c group by seq_no")
def running_counts(spark, sf_dir):
    return filters.read_summaries(reads(spark, sf_dir), K)


@query(f"""with {RUNNING_SQL}, s as (select seq_no, count(*)::bigint as n_kmers, count(*) filter (n < 2)::bigint as n_low from c group by seq_no)
select *, not (n_low / n_kmers >= 1 - 0.75) as passed from s""")
def solid_filter(spark, sf_dir):
    return filters.solid_whole_reads(reads(spark, sf_dir), K, 2, 0.75)


@query(f"""with {RUNNING_SQL}, s as (select seq_no, count(*)::bigint as n_kmers, count(*) filter (n < 4)::bigint as n_low from c group by seq_no)
select *, not (n_low / n_kmers >= 1 - 0.9) as passed from s""")
def solid_filter_of_four(spark, sf_dir):
    return filters.solid_whole_reads(reads(spark, sf_dir), K, 4, 0.9)


@query(f"with {COUNTED_SQL} select seq_no, count(*) filter (n >= 2) >= floor(0.5 + count(*) / 2) as passed from c group by seq_no")
def median_at_least(spark, sf_dir):
    return filters.reads_at_least(reads(spark, sf_dir), K, 2)


@query(f"""with {COUNTED_SQL}, m as (select seq_no, list_sort(list(n))[count(*) // 2 + 1]::bigint as median, md5(string_agg(substr(sequence, pos::int + 1, {K}), ',' order by pos)) as kmers from c join r using (seq_no) group by seq_no)
select seq_no, median, median > 1 and median <= 5 as passed, kmers from m""")
def median_in_range(spark, sf_dir):
    rows = filters.read_medians(reads(spark, sf_dir), K, 1, 5, hashes=True)
    text = F.array_join(F.transform("hashes", lambda x: kmer_text(x, K)), ",")
    return rows.select("seq_no", "median", "passed", F.md5(text.cast("binary")).alias("kmers"))


@query(f"with {COUNTED_SQL} select seq_no, count(*)::bigint as n, md5(string_agg(n::varchar, ',' order by pos)) as counts from c group by seq_no")
def count_vectors(spark, sf_dir):
    """The counts of each read's k-mers in order of place."""
    rows = filters.read_counts(reads(spark, sf_dir), K)
    return rows.select("seq_no", F.size("counts").cast("long").alias("n"), F.md5(F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").cast("binary")).alias("counts"))


@query(f"""with {kmers_sql(K)}, e as (select distinct kmer from k where seq_no % 2 = 0) select seq_no, count(*)::bigint as n_new, count(distinct kmer)::bigint as n_distinct, min(kmer) as least
from k where seq_no % 2 = 1 and kmer not in (select kmer from e) group by seq_no""")
def new_kmers(spark, sf_dir):
    """K-mers of odd reads that the store of even reads does not have."""
    rows = packed(spark, sf_dir)
    store = stores.exact_counts(rows.where("seq_no % 2 = 0"), "kmer")
    out = filters.new_kmers(rows.where("seq_no % 2 = 1"), store)
    return out.groupBy("seq_no").agg(F.count("*").alias("n_new"), F.countDistinct("kmer").alias("n_distinct"), kmer_text(F.min("kmer"), K).alias("least"))


@query(f"""with {kmers_sql(K)}, m as (select distinct substr(sequence, i, {K}) as kmer from (select sequence, unnest(range(1, length(sequence) - {K - 2})) as i from ({ITEMS_SQL}) where length(sequence) >= {K}))
select count(*)::bigint as n_unique, sum(n)::bigint as n_kmers from (select kmer, count(*) as n from k where kmer not in (select kmer from m) group by kmer)""")
def masked_store(spark, sf_dir):
    """The documents' store without the items' k-mers."""
    out = stores.masked(counted(spark, sf_dir), packed_kmers(items(spark, sf_dir), K), "kmer", bounded=True)
    return out.agg(F.count("*").alias("n_unique"), F.sum("count").alias("n_kmers"))


def _segments_sql(source: str, flag: str) -> str:
    return f"""with {source}, f as (select seq_no, pos, pos - row_number() over (partition by seq_no order by pos) as g from c where {flag})
    select seq_no, min(pos)::bigint as start, (max(pos) + 1)::bigint as "end" from f group by seq_no, g"""


@query(_segments_sql(COUNTED_SQL, "n >= 2"))
def solid_segments(spark, sf_dir):
    return filters.read_segments(reads(spark, sf_dir), K, 2)


@query(_segments_sql(RUNNING_SQL, "n = 1"))
def new_segments(spark, sf_dir):
    return filters.read_segments(reads(spark, sf_dir), K)


@query()
def digital_normalisation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_no"), "source")
    return filters.digital_normalisation(reads(spark, sf_dir).join(docs, "seq_no"), K, 2, sample="source")


@query()
def digital_normalisation_metrics(spark, sf_dir):
    return filters.filter_metrics(digital_normalisation(spark, sf_dir), 100_000)


@query(f"""with {RUNNING_SQL}, s as (select seq_no, count(*)::bigint as n, count(*) filter (n < 2) as low from c group by seq_no), v as (select seq_no, n, not (low / n >= 1 - 0.75) as passed from s),
u as (select seq_no, sum(n) over (order by seq_no) as t, count(*) over (order by seq_no) as seq_t, sum(passed::int) over (order by seq_no) as p from v)
select (t // 100000)::bigint as tick, max(seq_t)::bigint as seq_t, max(t)::bigint as t, max(p)::bigint as n_seqs_passed, round(max(p) / max(seq_t), 9) as p_seqs_passed from u where t >= 100000 group by 1""")
def solid_filter_metrics(spark, sf_dir):
    """How many reads of the run so far had passed, at each interval."""
    out = filters.filter_metrics(solid_filter(spark, sf_dir).withColumn("sample", F.lit("")), 100_000)
    return out.select(F.col("tick").cast("long").alias("tick"), "seq_t", "t", "n_seqs_passed", F.round("p_seqs_passed", 9).alias("p_seqs_passed"))
