"""Queries of de Bruijn graphs over the documents' reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.blocks import counted_kmers
from strandlake.kmers import kmer_text, packed_kmers
from strandlake.operators import filters, graph
from strandlake.plans.common import RC_SQL, counted, items, kmers_sql, query
from strandlake.plans.projection import READS_SQL, reads
from strandlake.sources import fastx, graph_files
from strandlake.tables import shared_path

GRAPH_K = 15


@query(f"""with {kmers_sql(13)}, n as (select distinct kmer from k), le as (select substr(kmer, 2) as o, count(*) as d from n group by 1), ri as (select substr(kmer, 1, 12) as o, count(*) as d from n group by 1),
g as (select coalesce(le.d, 0)::bigint as left_degree, coalesce(ri.d, 0)::bigint as right_degree from n left join le on le.o = substr(kmer, 1, 12) left join ri on ri.o = substr(kmer, 2))
select left_degree, right_degree, count(*)::bigint as n from g group by 1, 2""")
def graph_degrees(spark, sf_dir):
    return graph.degrees(counted(spark, sf_dir, 13), 13).groupBy("left_degree", "right_degree").agg(F.count("*").alias("n"))


def _solid(spark: SparkSession, sf_dir: str, k: int = GRAPH_K, canonical: bool = False, least: int = 1) -> DataFrame:
    return counted(spark, sf_dir, k, canonical, least)


def _graph(spark: SparkSession, sf_dir: str, canonical: bool = False, least: int = 1) -> graph.Compacted:
    return graph.Compacted(_solid(spark, sf_dir, GRAPH_K, canonical, least), GRAPH_K, canonical)


def nodes_sql(canonical: bool = False, least: int = 1, k: int = GRAPH_K) -> str:
    """n: nodes (kmer), of both strands if canonical; dg: their degrees; d: decision nodes; p: links of plain nodes."""
    n = f"c as (select kmer from k group by kmer having count(*) >= {least})"
    if canonical:
        n = f"b as (select least(kmer, {RC_SQL.format('kmer')}) as kmer from k group by 1 having count(*) >= {least}), c as (select kmer from b union select {RC_SQL.format('kmer')} from b)"
    return f"""{kmers_sql(k)}, {n}, n as materialized (select kmer, substr(kmer, 1, {k - 1}) as pre, substr(kmer, 2) as suf from c),
    le as (select suf as o, count(*) as d from n group by 1), ri as (select pre as o, count(*) as d from n group by 1),
    dg as materialized (select kmer, pre, suf, coalesce(le.d, 0)::bigint as left_degree, coalesce(ri.d, 0)::bigint as right_degree from n left join le on le.o = pre left join ri on ri.o = suf),
    d as materialized (select * from dg where left_degree > 1 or right_degree > 1), q as materialized (select * from dg where left_degree <= 1 and right_degree <= 1),
    p as materialized (select a.kmer as src, b.kmer as dst from q a join q b on a.suf = b.pre)"""


def unitigs_sql(canonical: bool = False, least: int = 1, k: int = GRAPH_K) -> str:
    """u: linear unitigs by recursion from their heads; rings: cycles, by recursion from each of their nodes that no lesser one precedes."""
    ends = f"where sequence <= {RC_SQL.format('sequence')}" if canonical else ""
    return f"""{nodes_sql(canonical, least, k)}, h as (select kmer from q anti join p on q.kmer = p.dst),
    w as (select kmer as head, kmer as tip, kmer as sequence from h union all select head, dst, sequence || substr(dst, {k}) from w join p on src = tip),
    l as (select head, max_by(sequence, length(sequence)) as sequence from w group by head), u as (select * from l {ends}),
    seen as (select substr(sequence, i, {k}) as kmer from (select sequence, unnest(range(1, length(sequence) - {k - 2})) as i from l)),
    rest as materialized (select p.src, p.dst from p anti join seen on p.src = seen.kmer),
    v as (select src as head, dst as tip, src as sequence, dst >= src as ok from rest union all select head, dst, sequence || substr(tip, {k}), dst >= head from v join rest on src = tip where ok and tip <> head),
    rings as (select head, sequence from v where tip = head and ok)"""


@query(f"with {nodes_sql()} select count(*)::bigint as n, count(distinct a.kmer)::bigint as n_src, count(distinct b.kmer)::bigint as n_dst, min(a.kmer || b.kmer) as least, max(a.kmer || b.kmer) as most from n a join n b on a.suf = b.pre")
def graph_edges(spark, sf_dir):
    text = lambda c: kmer_text(F.col(c), GRAPH_K)
    e = graph.edges(_solid(spark, sf_dir), GRAPH_K)
    pair = F.struct("src", "dst")
    out = e.agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.min(pair).alias("least"), F.max(pair).alias("most"))
    return out.select("n", "n_src", "n_dst", *[F.concat(text(f"{c}.src"), text(f"{c}.dst")).alias(c) for c in ("least", "most")])


@query(f"with recursive {unitigs_sql()} select sequence, false as circular from u union all select sequence, true from rings")
def graph_unitigs(spark, sf_dir):
    return _graph(spark, sf_dir).unitigs.select("sequence", "circular")


@query(f"with recursive {unitigs_sql()} select sequence from u")
def graph_update(spark, sf_dir):
    """Linear unitigs of a graph of even reads that was saved, loaded and took in the odd ones."""
    rows, path = reads(spark, sf_dir), shared_path(spark, "graph")
    graph.Compacted(counted_kmers(rows.where("seq_no % 2 = 0"), GRAPH_K), GRAPH_K).save(path)
    made = graph.Compacted.load(spark, path).updated(counted_kmers(rows.where("seq_no % 2 = 1"), GRAPH_K))
    return made.unitigs.where("not circular").select("sequence")


@query(f"with {nodes_sql(False, 2)} select kmer as sequence, 'DECISION' as meta, length(kmer)::int as length from d")
def graph_fasta(spark, sf_dir):
    """Decision nodes of the graph of repeated k-mers, from a FASTA file of it."""
    path = shared_path(spark, "graph-fasta")
    graph_files.write_graph(_graph(spark, sf_dir, least=2), path, "fasta")
    rows = fastx.read_fastx(spark, path, kind="fasta").select("sequence", F.regexp_extract("comment", "type=([A-Z]+)", 1).alias("meta"), F.regexp_extract("comment", "L=([0-9]+)", 1).cast("int").alias("length"))
    return rows.where("meta = 'DECISION'")


@query(f"with recursive {unitigs_sql(True)} select sequence from u")
def canonical_unitigs(spark, sf_dir):
    """Linear unitigs of the graph of both strands."""
    return _graph(spark, sf_dir, True).unitigs.where("not circular").select("sequence")


@query(f"with recursive {unitigs_sql(False, 2)} select sequence from u")
def solid_unitigs(spark, sf_dir):
    """Linear unitigs of the k-mers that were found twice or more."""
    return _graph(spark, sf_dir, least=2).unitigs.where("not circular").select("sequence")


_KINDED = f"""{unitigs_sql()}, lu as (select u.head, u.sequence, x.kmer as ld, y.kmer as rd from u left join d x on x.suf = substr(u.sequence, 1, {GRAPH_K - 1}) left join d y on y.pre = substr(u.sequence, length(u.sequence) - {GRAPH_K - 2})),
kinds as (select head, sequence, ld, rd, case when length(sequence) = {GRAPH_K} then 'TRIVIAL' when ld is null and rd is null then 'ISLAND' when ld = rd then 'LOOP' when ld is null or rd is null then 'TIP' else 'FULL' end as meta from lu)"""


@query(f"with recursive {_KINDED} select meta, count(*)::bigint as n from kinds group by meta union all select 'DECISION', count(*)::bigint from d having count(*) > 0 union all select 'CIRCULAR', count(*)::bigint from (select distinct head from rings where length(sequence) > 1) having count(*) > 0")
def graph_unitig_kinds(spark, sf_dir):
    return _graph(spark, sf_dir).metrics()


@query(f"""with recursive {_KINDED} select head as left_end, sequence[length(sequence) - {GRAPH_K - 1}:] as right_end, meta, ld as left_dnode, rd as right_dnode from kinds""")
def graph_nodes(spark, sf_dir):
    """Linear unitigs with their ends and the decision nodes beside them."""
    return _graph(spark, sf_dir).unitigs.where("not circular").select("left_end", "right_end", "meta", "left_dnode", "right_dnode")


@query(f"with {nodes_sql()} select kmer, left_degree, right_degree from d")
def decision_nodes(spark, sf_dir):
    made = graph.decision_nodes(_solid(spark, sf_dir), GRAPH_K)
    return made.select(kmer_text(F.col("kmer"), GRAPH_K).alias("kmer"), "left_degree", "right_degree")


@query(f"""with recursive {unitigs_sql()}, b as (select case when length(sequence) >= 50 then 50 when length(sequence) >= 20 then 20 else 15 end as bin, length(sequence) - {GRAPH_K - 1} as n from u)
select bin::int as bin, sum(n)::bigint as n_kmers from b group by bin""")
def unitig_histogram(spark, sf_dir):
    """K-mers of linear unitigs by their length."""
    made = _graph(spark, sf_dir)
    made.unitigs = made.unitigs.where("not circular")
    return made.length_histogram([15, 20, 50])


@query(f"with {kmers_sql(GRAPH_K)} select count(distinct kmer)::bigint as n_nodes, count(distinct kmer)::bigint as n_in_graph, 0::bigint as n_missing, 0::bigint as n_foreign, 0::bigint as n_repeated from k")
def graph_validation(spark, sf_dir):
    """The graph's k-mers, taken from its unitigs and decision nodes, against the store, one by one."""
    return _graph(spark, sf_dir).validate()


@query()
def graph_components(spark, sf_dir):
    return _graph(spark, sf_dir).components().groupBy("component").agg(F.count("*").alias("size"))


@query()
def component_stats(spark, sf_dir):
    return _graph(spark, sf_dir, True).component_stats()


@query()
def graph_report(spark, sf_dir):
    """Counts of nodes by kind, in one row."""
    return _graph(spark, sf_dir, True).report()


@query()
def graph_gfa(spark, sf_dir):
    return graph_files.gfa_lines(_graph(spark, sf_dir)).select("value")


def _asked(spark, sf_dir):
    """The items' k-mers as texts."""
    return packed_kmers(items(spark, sf_dir), GRAPH_K).select("kmer").distinct().select(kmer_text(F.col("kmer"), GRAPH_K).alias("kmer"))


_ASKED = f"asked as (select distinct substr(sequence, i, {GRAPH_K}) as kmer from (select sequence, unnest(range(1, length(sequence) - {GRAPH_K - 2})) as i from ({READS_SQL.replace('doc_id as', 'item_id as').replace('from documents', 'from benchmark')}) where length(sequence) >= {GRAPH_K}))"


@query(f"""with recursive {unitigs_sql()}, {_ASKED}, all_k as (select substr(sequence, i, {GRAPH_K}) as kmer, 'u:' || head as node, i - 1 as pos from (select head, sequence, unnest(range(1, length(sequence) - {GRAPH_K - 2})) as i from u) union all select kmer, 'd:' || kmer, 0 from d)
select kmer, node, pos::bigint as pos from asked join all_k using (kmer)""")
def node_lookup(spark, sf_dir):
    """The node and the place in it of every k-mer of the items that is not on a cycle."""
    found = _graph(spark, sf_dir).find(_asked(spark, sf_dir)).select("kmer", "node", "pos")
    return found


@query(f"""with recursive {nodes_sql()}, {_ASKED}, x as (select asked.kmer as seed, dg.right_degree as o from asked left join dg using (kmer)),
w as (select seed, seed as tip, seed as sequence, case when o is null then 'BAD_SEED' when o = 0 then 'STOP_FWD' when o > 1 then 'DECISION_FWD' end as state from x
union all select seed, case when y.left_degree > 1 or contains(sequence, y.kmer) then tip else y.kmer end, case when y.left_degree > 1 or contains(sequence, y.kmer) then sequence else sequence || substr(y.kmer, {GRAPH_K}) end,
  case when contains(sequence, y.kmer) then 'STOP_SEEN' when y.left_degree > 1 then 'DECISION_BKW' when y.right_degree = 0 then 'STOP_FWD' when y.right_degree > 1 then 'DECISION_FWD' end
  from w join dg y on y.pre = substr(tip, 2) where state is null)
select seed, sequence, state as end_state from w where state is not null""")
def graph_walks(spark, sf_dir):
    """Walks to the right from every k-mer of the items."""
    return _graph(spark, sf_dir).walks(_asked(spark, sf_dir))


@query(f"""with {nodes_sql()}, {_ASKED}, s as (select unnest(['A', 'C', 'G', 'T']) as s), near as (select kmer, 'right' as side, s as symbol, substr(kmer, 2) || s as neighbour from asked, s union all select kmer, 'left', s, s || substr(kmer, 1, {GRAPH_K - 1}) from asked, s)
select near.kmer, side, symbol, neighbour from near semi join n on n.kmer = neighbour""")
def graph_neighbours(spark, sf_dir):
    """Neighbours of the items' k-mers on both sides, where the graph has them."""
    node = _solid(spark, sf_dir)
    seeds = packed_kmers(items(spark, sf_dir), GRAPH_K).select("kmer").distinct()
    sides = [graph.neighbours(node, seeds, GRAPH_K, side).withColumn("side", F.lit(side)) for side in ("left", "right")]
    text = lambda c: kmer_text(F.col(c), GRAPH_K).alias(c)
    return sides[0].unionByName(sides[1]).select(text("kmer"), "side", "symbol", text("neighbour"))


@query(f"""with r as ({READS_SQL}), s as (select seq_no as node_id, sequence as s, length(sequence) as n from r where length(sequence) > {2 * GRAPH_K}),
e as (select node_id, s, n, n // 2 - {GRAPH_K // 2} as p from s)
select node_id, substr(s, 2) as left_clipped, substr(s, 1, n - 1) as right_clipped, substr(s, 1, p + {GRAPH_K - 1}) as left_part, substr(s, p + 2) as right_part,
  s || substr(s, 2, 3) as extended, reverse(translate(s, 'ACGT', 'TGCA')) as flipped from e""")
def node_edits(spark, sf_dir):
    """Reads as nodes: clipped at each end, split in the middle, extended and turned round; what was split is merged again on the way."""
    k = GRAPH_K
    rows = reads(spark, sf_dir).where(F.length("sequence") > 2 * k).select(F.col("seq_no").alias("node_id"), "sequence")
    place = (F.floor(F.length("sequence") / 2) - k // 2).cast("int")
    at = rows.select("node_id", "sequence", place.alias("at"), F.lit(False).alias("circular"))
    parts = graph.split(at, k).groupBy("node_id").pivot("part", [0, 1]).agg(F.first("sequence")).withColumnsRenamed({"0": "left_part", "1": "right_part"})
    # the cut k-mer spans the parts: merging them with it gives the node back, which is then extended
    span = at.select("node_id", F.substr("sequence", F.col("at") + 1, F.lit(k)).alias("span")).join(parts, "node_id")
    whole = span.select("node_id", F.concat("left_part", F.substr("span", F.lit(k)), F.substr("right_part", F.lit(k))).alias("sequence"))
    more = whole.select("node_id", "sequence", F.concat(F.substr(F.col("sequence"), F.length("sequence") - k + 2), F.substr("sequence", F.lit(2), F.lit(3))).alias("more"))
    out = parts.join(graph.extended(more, k).withColumnRenamed("sequence", "extended"), "node_id")
    for side in ("left", "right"):
        out = out.join(graph.clipped(rows, k, side).withColumnRenamed("sequence", f"{side}_clipped"), "node_id")
    return out.join(graph.flipped(rows).withColumnRenamed("sequence", "flipped"), "node_id").select("node_id", "left_clipped", "right_clipped", "left_part", "right_part", "extended", "flipped")


@query(f"""with {kmers_sql(GRAPH_K)}, n as (select kmer, count(*)::bigint as n from k group by kmer), b as (select least(kmer, {RC_SQL.format('kmer')}) as kmer, sum(n)::bigint as n from n group by 1)
select count(*)::bigint as n_unique, sum(n)::bigint as n_kmers, count(*) filter (n >= 2)::bigint as n_solid, max(n)::bigint as most from b""")
def canonical_store(spark, sf_dir):
    """A store of both strands, from the counts of each."""
    node = counted(spark, sf_dir, GRAPH_K, canonical=True)
    return node.agg(F.count("*").alias("n_unique"), F.sum("count").alias("n_kmers"), F.count_if(F.col("count") >= 2).alias("n_solid"), F.max("count").alias("most"))


@query(f"""with {kmers_sql(GRAPH_K)}, s as (select kmer, count(*) as n from k group by kmer), c as (select k.seq_no, pos from k join s using (kmer) where n >= 2), g as (select seq_no, pos, pos - row_number() over (partition by seq_no order by pos) as g from c),
e as (select seq_no, min(pos) as b, max(pos) as e from g group by seq_no, g) select e.seq_no, e.b::bigint as start, substr(sequence, e.b::int + 1, (e.e - e.b)::int + {GRAPH_K}) as sequence from e join r using (seq_no)""")
def solid_segment_sequences(spark, sf_dir):
    """What of each read a compaction of solid k-mers takes in."""
    return filters.read_segments(reads(spark, sf_dir), GRAPH_K, 2, sequences=True)
