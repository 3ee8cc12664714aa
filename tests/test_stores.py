"""Named stores, samples and residues."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import distances, protein
from strandlake.operators import sketch, stores, tags


@pytest.mark.parametrize("kind", ["exact", "bloom", "cms8", "cms4", "cqf"])
def test_store_by_name(spark, tmp_path, kind):
    shape = stores.Shape(kind, 21, 10_000)
    rows = lambda *hs: spark.createDataFrame([(h,) for h in hs], "h long")
    store = stores.Store.build(rows(*[5] * 20, -7, 9), shape).union(stores.Store.build(rows(9, 9), shape))
    store.save(f"file://{tmp_path}/{kind}")
    back = stores.Store.load(spark, f"file://{tmp_path}/{kind}")
    assert back.shape == shape
    found = {r.h: r["count"] for r in back.query(rows(5, -7, 9, 12_345, 5)).collect()}
    most = {"bloom": 1, "cms4": 15}.get(kind, 20)
    assert found == {5: most, -7: 1, 9: 1 if kind == "bloom" else 3, 12_345: 0}
    with pytest.raises(ValueError):
        store.union(stores.Store.build(rows(1), stores.Shape(kind, 31, 10_000)))


def test_sample_is_stable_and_whole(spark):
    df = spark.range(100)
    first = {r.id for r in sketch.reservoir(df, 10, "id").collect()}
    assert len(first) == 10 and first == {r.id for r in sketch.reservoir(df.repartition(7), 10, "id").collect()}
    assert sketch.reservoir(df.limit(3), 10, "id").count() == 3


def test_residues(spark):
    df = spark.createDataFrame([("ATGTGGTAA", "MW*"), ("ATGAN", "M"), ("ATN", "X"), ("AT", ""), ("", ""), (None, None)], "s string, want string")
    assert all(r.got == r.want for r in df.select("want", protein.translate_sequence(F.col("s")).alias("got")).collect())
    row = spark.sql("select 'CAD*?' as s").select(protein.dayhoff(F.col("s")).alias("d"), protein.hydrophobic_polar(F.col("s")).alias("h")).first()
    assert tuple(row) == ("abc*X", "php*X")


def test_rolling_distances(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "t int, v array<double>")
    out = distances.rolling_distances(df, "v", "t", (2, 4), ("cityblock", "euclidean"))
    assert sorted((r.t, r.freq, r.metric, r.distance) for r in out.collect()) == sorted([(t, 2, m, 1.0) for t in (1, 2, 3) for m in ("cityblock", "euclidean")] + [(3, 4, m, 3.0) for m in ("cityblock", "euclidean")])
    assert [r.distance for r in distances.distances_from(df, "v", [0.0, 0.0], "euclidean").orderBy("t").collect()] == [0, 1, 2, 3]


def test_tags_of_reads(spark):
    rows = spark.createDataFrame([(0, 4, 1, 2), (0, 1, 0, 1), (1, 0, 0, 1)], "seq_no long, pos long, left_partition long, right_partition long")
    assert {(r.left_partition, r.right_partition, r.n_reads, r.n) for r in tags.tag_links(rows).collect()} == {(0, 1, 2, 2), (1, 2, 1, 1)}
    assert {r.seq_no: [tuple(p) for p in r.path] for r in tags.read_tags(rows).collect()} == {0: [(0, 1), (1, 2)], 1: [(0, 1)]}
