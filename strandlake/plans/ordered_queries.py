"""Queries of ordered analytics and distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import distances
from strandlake.operators import windows
from strandlake.plans.common import hash_sql, kmers_sql, query, table
from strandlake.plans.projection import READS_SQL, reads

_FRAME = "over (partition by event_type order by event_id rows between 4 preceding and current row)"


@query(f"""select event_id, case when n = 5 then round(mean, 6) end as mean, case when n = 5 then round(dev, 6) end as stddev, case when n = 5 then round(med, 6) end as median,
  case when n = 5 then round(mean / (t1 - t0), 9) end as normalized from (select event_id, count(value) {_FRAME} as n, avg(value) {_FRAME} as mean,
  stddev_pop(value) {_FRAME} as dev, median(value) {_FRAME} as med, last_value(event_id) {_FRAME} as t1, first_value(event_id) {_FRAME} as t0 from events)""")
def sliding_statistics(spark, sf_dir):
    df, by = table(spark, sf_dir, "events"), ("event_type",)
    stat = lambda f, name, d=6: F.round(windows.sliding(df, "value", "event_id", 5, f, by), d).alias(name)
    return df.select("event_id", stat("mean", "mean"), stat("stddev", "stddev"), stat("median", "median"), stat("normalized_mean", "normalized", 9))


@query(f"select event_id, case when count(value) {_FRAME} = 5 then round(max(value) {_FRAME} - min(value) {_FRAME}, 6) end as spread from events")
def window_function(spark, sf_dir):
    """Any NumPy function over sliding windows."""
    df = table(spark, sf_dir, "events")
    out = windows.applied(df.select("event_id", "event_type", "value"), "value", "event_id", 5, lambda v: v.max(axis=1) - v.min(axis=1), "event_type")
    return out.select("event_id", F.round("stat", 6).alias("spread"))


_STAT = "avg(value) over (partition by event_type order by event_id rows between 3 preceding and current row)"
_REACHED = f"""with s as (select *, row_number() over (partition by event_type order by event_id) as i, {_STAT} as m from events),
c as (select *, min(m) over (partition by event_type order by event_id rows between 3 preceding and current row) as low, max(m) over (partition by event_type order by event_id rows between 3 preceding and current row) as high from s),
f as (select *, i >= 7 and low > 40 as above, i >= 7 and high < 60 as below from c)"""


@query(f"{_REACHED} select event_id, above, below from f")
def sliding_cutoffs(spark, sf_dir):
    """Whether the last four means of four values are all above a cutoff, or below one."""
    df, by = table(spark, sf_dir, "events"), ("event_type",)
    out = windows.sliding_cutoff(df, "value", "event_id", 4, 40, by=by).drop("stat").withColumnRenamed("reached", "above")
    return windows.sliding_cutoff(out, "value", "event_id", 4, 60, above=False, by=by).select("event_id", "above", F.col("reached").alias("below"))


@query(f"{_REACHED}, b as (select *, coalesce(max(above::int) over (partition by event_type order by event_id rows between unbounded preceding and 1 preceding), 0) as seen from f) select event_id from b where seen = 0")
def until_saturated(spark, sf_dir):
    """Events of each type up to the first at which the cutoff is reached."""
    by = ("event_type",)
    out = windows.sliding_cutoff(table(spark, sf_dir, "events"), "value", "event_id", 4, 40, by=by)
    return windows.until_reached(out, "event_id", by=by).select("event_id")


@query(f"""with s as (select *, row_number() over (partition by event_type order by event_id) as i from events), d as (select *, case when i >= 5 then stddev_pop(value) {_FRAME} end as dev from s)
select event_type, min(event_id) filter (dev < 25) as first_below from d group by event_type""")
def first_below_deviation(spark, sf_dir):
    """The first event of each type at which the rolling deviation is below a cutoff."""
    df = table(spark, sf_dir, "events")
    rows = df.withColumn("dev", windows.sliding(df, "value", "event_id", 5, "stddev", ("event_type",)))
    return rows.groupBy("event_type").agg(F.min(F.when(F.col("dev") < 25, F.col("event_id"))).alias("first_below"))


@query("""with w as (select event_id, min(struct_pack(v := value, i := event_id)) over (partition by event_type order by event_id rows between 7 preceding and current row) as m,
  row_number() over (partition by event_type order by event_id) as n from events) select event_id, m.v as min_value, m.i as min_at from w where n >= 8""")
def interior_minimizers(spark, sf_dir):
    return windows.interior_minimizers(table(spark, sf_dir, "events"), "value", "event_id", 8, ("event_type",)).select("event_id", "min_value", "min_at")


@query(f"""with {kmers_sql(11)}, h as (select seq_no, pos, kmer, {hash_sql("kmer")} as h from k),
w as (select seq_no, min(struct_pack(h := h, pos := pos, kmer := kmer)) over (partition by seq_no order by pos rows between 9 preceding and current row) as m, row_number() over (partition by seq_no order by pos) as i from h)
select distinct seq_no, m.pos::bigint as pos, m.h::varchar as h, m.kmer as kmer from w where i >= 10""")
def window_minimizers(spark, sf_dir):
    """The least-hashing k-mer of every ten in a row, each once."""
    return windows.kmer_minimizers(reads(spark, sf_dir), 10, 11)


@query("select event_id, round(value - lag(value) over (partition by user_id order by event_id), 9) as change from events")
def pairwise_change(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", F.round(windows.pairwise(df, "value", "event_id", lambda x, y: y - x, ("user_id",)), 9).alias("change"))


_TICKS = f"""with recursive r as ({READS_SQL}), d as (select lang, seq_no, length(sequence) as n, row_number() over (partition by lang order by seq_no) as i from r join documents on seq_no = doc_id),
s as (select lang, i, seq_no, n as t, case when n >= 50000 then 0 else n end as held, (n >= 50000)::int as tick, n >= 50000 as hit from d where i = 1
union all select d.lang, d.i, d.seq_no, s.t + d.n, case when s.held + d.n >= 50000 then 0 else s.held + d.n end, s.tick + (s.held + d.n >= 50000)::int, s.held + d.n >= 50000
from s join d on d.lang = s.lang and d.i = s.i + 1)"""


def _interval_ticks(spark, sf_dir):
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_no"), "lang")
    rows = reads(spark, sf_dir).select("seq_no", F.length("sequence").cast("long").alias("n")).join(lang, "seq_no")
    return windows.interval_ticks(rows, "seq_no", "n", 50_000, "lang")


@query(f"{_TICKS} select lang, seq_no, tick::bigint as tick, t::bigint as t from s where hit")
def interval_ticks(spark, sf_dir):
    return _interval_ticks(spark, sf_dir)


@query(f"""{_TICKS}, fib as (select 1 as x, 1 as a, 1 as b union all select x + b, b, a + b from fib where x + b <= 100),
ex as (select 0 as i, 1 as x union all select i + 1, x + greatest(1, floor(pow(1.08, i + 1))::int) from ex where x < 100)
select lang, tick::bigint as tick, tick % 3 = 0 as every_third, tick in (select x from fib) as fibonacci, tick in (select x from ex) as exponential from s where hit and tick <= 100""")
def throttled_ticks(spark, sf_dir):
    """Which ticks fire: each third, those with Fibonacci gaps, those with exponential gaps."""
    rows = _interval_ticks(spark, sf_dir).where("tick <= 100")
    tick = F.col("tick")
    return rows.select("lang", "tick", tick.isin(windows.every_n(range(1, 101), 3)).alias("every_third"), tick.isin(windows.fib_ticks(100)).alias("fibonacci"), tick.isin(windows.exp_ticks(100)).alias("exponential"))


# --- distances

_VECTOR_SQL = {
    "cosine": "1 - list_sum(list_transform(z, lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(z, lambda p: p[1] * p[1]))) * sqrt(list_sum(list_transform(z, lambda p: p[2] * p[2]))))",
    "euclidean": "sqrt(list_sum(list_transform(z, lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "sqeuclidean": "list_sum(list_transform(z, lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "cityblock": "list_sum(list_transform(z, lambda p: abs(p[1] - p[2])))",
    "chebyshev": "list_max(list_transform(z, lambda p: abs(p[1] - p[2])))",
    "minkowski": "pow(list_sum(list_transform(z, lambda p: pow(abs(p[1] - p[2]), 3))), 1 / 3.0::double)",
    "canberra": "list_sum(list_transform(z, lambda p: case when abs(p[1]) + abs(p[2]) = 0 then 0 else abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) end))",
    "braycurtis": "list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))) / list_sum(list_transform(z, lambda p: abs(p[1] + p[2])))",
    "correlation": "1 - list_sum(list_transform(c, lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(c, lambda p: p[1] * p[1]))) * sqrt(list_sum(list_transform(c, lambda p: p[2] * p[2]))))",
    "angular": "1 - 2 * acos(greatest(-1, least(1, list_sum(list_transform(z, lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(z, lambda p: p[1] * p[1]))) * sqrt(list_sum(list_transform(z, lambda p: p[2] * p[2]))))))) / pi()",
    "jensenshannon": "sqrt(greatest(list_sum(list_transform(s, lambda p: case when p[1] > 0 then p[1] * ln(2 * p[1] / (p[1] + p[2])) else 0 end + case when p[2] > 0 then p[2] * ln(2 * p[2] / (p[1] + p[2])) else 0 end)) / 2, 0))",
    "seuclidean": "sqrt(list_sum(list_transform(range(1, len(z) + 1), lambda i: (z[i][1] - z[i][2]) * (z[i][1] - z[i][2]) / i)))",
    "mahalanobis": "sqrt(list_sum(list_transform(range(1, len(z) + 1), lambda i: (z[i][1] - z[i][2]) * (z[i][1] - z[i][2]) * (1 + i % 2))))",
}


@query(f"""with v as (select vec_id, embedding::double[] as a from embeddings), f as (select a as b from v order by vec_id limit 1),
z as (select vec_id, list_transform(range(1, len(a) + 1), lambda i: [a[i], b[i]]) as z, list_transform(range(1, len(a) + 1), lambda i: [a[i] - list_avg(a), b[i] - list_avg(b)]) as c,
  list_transform(range(1, len(a) + 1), lambda i: [abs(a[i]) / list_sum(list_transform(a, lambda x: abs(x))), abs(b[i]) / list_sum(list_transform(b, lambda x: abs(x)))]) as s from v, f)
select vec_id, {", ".join(f"round({sql}, 5) + 0.0 as {name}" for name, sql in _VECTOR_SQL.items())} from z""")
def vector_distances(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("b"))
    a, b = F.col("embedding"), F.col("b")
    positive = lambda c: F.transform(c, F.abs)
    place = lambda f: F.transform(a, lambda x, i: f(i))
    inverse = F.transform(a, lambda x, i: F.transform(a, lambda y, j: F.when(i == j, 1.0 + (i + 1) % 2).otherwise(0.0)))
    args = {"minkowski": (3.0,), "seuclidean": (place(lambda i: (i + 1).cast("double")),), "mahalanobis": (inverse,)}
    sides = lambda m: (positive(a), positive(b)) if m == "jensenshannon" else (a, b)
    d: Callable[[str], Column] = lambda m: (F.round(distances.distance(*sides(m), m, *args.get(m, ())), 5) + F.lit(0.0)).alias(m)
    return v.join(F.broadcast(first)).select("vec_id", *map(d, _VECTOR_SQL))


@query("""with v as (select vec_id, embedding::double[] as a from embeddings), w as (select vec_id, a, lag(a, 1) over (order by vec_id) as b2, lag(a, 3) over (order by vec_id) as b4, max(vec_id) over () as last from v),
u as (select vec_id, last, 2 as freq, a, b2 as b from w union all select vec_id, last, 4, a, b4 from w)
select vec_id, freq, 'euclidean' as metric, round(list_distance(a, b), 5) as distance, round(vec_id / last, 9) as time_norm from u where b is not null""")
def rolling_signature_distances(spark, sf_dir):
    out = distances.rolling_distances(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", (2, 4), ("euclidean",))
    return out.withColumn("distance", F.round("distance", 5)).withColumn("time_norm", F.round("time_norm", 9))


@query("""with v as (select vec_id, embedding::double[] as a from embeddings), f as (select a as b from v order by vec_id desc limit 1) select vec_id, round(list_distance(a, b), 5) as distance from v, f""")
def reference_distances(spark, sf_dir):
    """Distances from one reference vector, which is part of the plan."""
    v = table(spark, sf_dir, "embeddings")
    last = v.orderBy(F.desc("vec_id")).limit(1).collect()
    out = distances.distances_from(v, "embedding", [float(x) for x in last[0].embedding] if last else [], "euclidean")
    return out.select("vec_id", F.round("distance", 5).alias("distance"))


@query("""with u as (select label, i, avg(embedding[i])::double as x from embeddings, (select unnest(range(1, 1 + (select max(len(embedding)) from embeddings))) as i) group by label, i)
select a.label as a, b.label as b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 5) as distance from u a join u b on a.i = b.i and a.label < b.label group by 1, 2""")
def distance_matrix(spark, sf_dir):
    """Distances of all pairs of labels' mean vectors."""
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = v.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return distances.distance_matrix(means, "label", "mean", "euclidean").select("a", "b", F.round("distance", 5).alias("distance"))
