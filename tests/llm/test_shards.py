"""Shards under a versioned manifest: rows, places, racing writers, merges and orphans."""

import threading

import pyarrow.parquet as pq
import pytest

from strandlake.llm import compaction
from strandlake.llm.compaction import CommitConflict, ShardFile, ShardSet, shard_documents
from strandlake.llm.scratch import new_folder

ROWS = [(i if i % 9 else None, None if i % 7 == 0 else "é" * (i % 13), i, "x") for i in range(200)] + [(3, "again", 1, "y")] * 4


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, shard int, position string")


def local(path):
    return path.removeprefix("file:")


def test_every_row_is_where_it_is_said_to_be(spark, docs):
    root = new_folder(spark, "shards")
    got = shard_documents(docs.repartition(11), 6_000, root).collect()
    files = sorted(s.path for s in ShardSet(spark, root).shards())
    held = [pq.read_table(local(f)).to_pylist() for f in files]
    assert sorted((r.shard, r.position) for r in got) == [(k, i) for k, rows in enumerate(held) for i in range(len(rows))]
    for r in got:
        row = held[r.shard][r.position]
        assert (r.doc_id, r.n_bytes) == (row["doc_id"], len((row["text"] or "").encode()))
    every = sorted((tuple(row.values()) for rows in held for row in rows), key=repr)
    assert every == sorted(ROWS, key=repr)
    assert list(held[0][0]) == docs.columns


def test_arrivals_merge_by_size(spark, docs):
    shards = ShardSet(spark, new_folder(spark, "shards"), 20_000)
    for n in range(10):
        shards.append(docs.where(f"abs(hash(text, shard)) % 10 = {n}").coalesce(1))
        shards.compact()
        sizes = {}
        for s in shards.shards():
            sizes.setdefault(s.tier(20_000), []).append(s)
        assert all(len(own) < compaction.MERGE_FROM for tier, own in sizes.items() if tier)
    assert sorted(map(tuple, shards.read().collect()), key=repr) == sorted(ROWS, key=repr)
    # any version can be read while its files are kept
    assert shards.read(1).count() == docs.where("abs(hash(text, shard)) % 10 = 0").count()
    named = {s.path for s in shards.shards()}
    assert shards.remove_orphans(older_than_ms=10**9) == 0
    assert shards.remove_orphans(older_than_ms=0) > 0
    assert {s.path for s in shards.shards()} == named and shards.read().count() == len(ROWS)


def test_whole_lists_are_kept_now_and_then(spark):
    shards = ShardSet(spark, new_folder(spark, "shards"))
    for n in range(compaction.CHECKPOINT + 3):
        shards.commit(n, [ShardFile(f"f{n}", n)], [f"f{n - 2}"] if n > 1 else [])
        assert [s.path for s in shards.shards()] == [f"f{k}" for k in range(max(0, n - 1), n + 1)]
    assert "shards" in shards._manifest(compaction.CHECKPOINT) and "shards" not in shards._manifest(compaction.CHECKPOINT + 1)
    with pytest.raises(CommitConflict):
        shards.commit(3, [])


def test_writers_race(spark, docs):
    root = new_folder(spark, "shards")
    made = ShardSet(spark, root, 50_000)
    made.append(docs.repartition(6))
    late, commit = [], made.commit

    def slow(base, added, removed=()):
        if removed and not late:  # an arrival comes while the merge is under way
            late.append(ShardSet(spark, root).append(docs.coalesce(1)))
        return commit(base, added, removed)

    made.commit = slow
    made.compact()
    assert late and made.read().count() == 2 * len(ROWS)
    writers = [threading.Thread(target=lambda: ShardSet(spark, root).append(docs.limit(5).coalesce(1))) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert made.read().count() == 2 * len(ROWS) + 20
    # of two merges of the same files one commits
    other = ShardSet(spark, root, 50_000)
    run = other._small(other.shards(), 2)
    other.commit(other.version(), other._merged(run), [s.path for s in run])
    made.commit = commit
    made.compact()
    assert made.read().count() == 2 * len(ROWS) + 20


def test_nothing_is_committed_of_nothing(spark, docs):
    shards = ShardSet(spark, new_folder(spark, "shards"))
    assert shards.append(docs.limit(0)) == 0 and shards.shards() == [] and shards.read() is None
    assert shard_documents(docs.limit(0)).count() == 0
