"""Operator 9: shards kept by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards.  Shards of similar size
(a tier: powers of FANOUT below the target) are merged once a tier has enough of
them, into files near the target size.  Readers follow the manifest of highest
version; a commit creates the next version's file, which succeeds for one writer
only.  Nothing that a committed manifest names is changed.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.scratch import hadoop_path, new_folder

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Shards of one tier from which they are merged.
MERGE_FROM = 4
#: Versions from one whole list of shards to the next.
CHECKPOINT = 16


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class ShardFile:
    path: str
    size: int

    def tier(self, target: int) -> int:
        """0 from half the target on; each further tier is FANOUT times smaller."""
        return max(0, math.ceil(math.log(target / 2 / max(self.size, 1), FANOUT)))


class ShardSet:
    """A folder of shards on any Hadoop file system.

    Version n's manifest says what it adds to version n - 1 and what it takes
    away, so a commit costs as much as it changes; each CHECKPOINT-th also has the
    whole list, from which readers start.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self.fs, top = hadoop_path(spark, self.root)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs.mkdirs(self._path(f"{self.root}/manifests"))

    # --- manifests

    def version(self) -> int:
        """The highest committed version; 0 before any."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[ShardFile]:
        """The shards of a version, in the order in which they came."""
        version = self.version() if version is None else version
        changes, own = [], {}
        for v in range(version, 0, -1):
            manifest = self._manifest(v)
            if "shards" in manifest:
                own = {x["path"]: ShardFile(**x) for x in manifest["shards"]}
                break
            changes.append(manifest)
        for manifest in reversed(changes):
            for path in manifest["removed"]:
                del own[path]
            own |= {x["path"]: ShardFile(**x) for x in manifest["added"]}
        return list(own.values())

    def _manifest(self, version: int) -> dict:
        lines = self.fs.open(self._path(self._name(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(lines, "UTF-8"))
        finally:
            lines.close()

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:012d}.json"

    def commit(self, base: int, added: list[ShardFile], removed: list[str] = []) -> int:  # noqa: B006 - not changed
        """Make version base + 1 of what changes, or raise CommitConflict if that exists.

        The whole text is written aside, then renamed without overwriting.
        """
        version = base + 1
        manifest = {"version": version, "added": [asdict(s) for s in added], "removed": list(removed)}
        if version % CHECKPOINT == 0:
            gone = set(removed)
            manifest["shards"] = [asdict(s) for s in [*(x for x in self.shards(base) if x.path not in gone), *added]]
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._path(self._name(version)), none)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    # --- data

    def _write(self, df: DataFrame) -> list[ShardFile]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        files = [s for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        if len(files) == 1 and df.sparkSession.read.parquet(folder).limit(1).count() == 0:
            self.fs.delete(self._path(folder), True)  # an empty table leaves one file without rows
            return []
        return [ShardFile(s.getPath().toString(), s.getLen()) for s in files]

    def append(self, df: DataFrame) -> int:
        """Write an arrival, one shard for each of its partitions that has rows, and commit it; nothing is committed of an empty one."""
        new = self._write(df)
        while True:
            base = self.version()
            if not new:
                return base
            try:
                return self.commit(base, new)
            except CommitConflict:
                continue

    def _small(self, shards: list[ShardFile], least: int) -> list[ShardFile]:
        """Shards of all tiers below the first that have at least ``least`` of them."""
        tiers: dict[int, list[ShardFile]] = {}
        for s in shards:
            if s.tier(self.target) > 0:
                tiers.setdefault(s.tier(self.target), []).append(s)
        return [s for own in tiers.values() if len(own) >= least for s in own]

    def _merged(self, run: list[ShardFile]) -> list[ShardFile]:
        """One job for all: the scan packs whole small files into partitions of up to the target, a file each, and shuffles nothing."""
        session = self.spark.newSession()
        for name, value in (("maxPartitionBytes", self.target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            session.conf.set(f"spark.sql.files.{name}", str(value))
        return self._write(session.read.parquet(*[s.path for s in run]))

    def compact(self, least: int = MERGE_FROM) -> int:
        """Merge until no tier has ``least`` shards; each round is one job and one commit.  Returns the version."""
        while True:
            base = self.version()
            run = self._small(self.shards(base), least)
            if not run:
                return base
            made, gone = self._merged(run), [s.path for s in run]
            if len(made) >= len(run):  # nothing fits together
                return base
            while True:
                try:
                    self.commit(base, made, gone)
                    break
                except CommitConflict:  # arrivals came in between; they stay beside what was merged
                    base = self.version()
                    if not set(gone) <= {s.path for s in self.shards(base)}:
                        break  # another compaction took a part of these: begin anew

    def remove_orphans(self, keep: int = 1, older_than_ms: int = 86_400_000) -> int:
        """Delete data files that none of the last ``keep`` versions names and that are old enough to be no one's work in hand; their number."""
        last = self.version()
        named = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)}
        before, data = int(time.time() * 1000) - older_than_ms, self._path(f"{self.root}/data")
        n, files = 0, self.fs.listFiles(data, True) if self.fs.exists(data) else None
        while files is not None and files.hasNext():
            f = files.next()
            if f.getPath().toString() not in named and f.getModificationTime() <= before:
                self.fs.delete(f.getPath(), False)
                n += f.getPath().getName().startswith("part-")
        return n

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version; None where it has no shard."""
        shards = self.shards(version)
        return self.spark.read.parquet(*[s.path for s in shards]) if shards else None


def shard_documents(docs: DataFrame, target_bytes: int = TARGET_BYTES, root: str | None = None) -> DataFrame:
    """Append ``docs`` as an arrival, compact, and say where each row lies.

    Per row: doc_id, shard (its number by path), position (its row number in the
    shard) and n_bytes of its text (null: 0), read back from the committed shards.
    All columns of ``docs`` are kept in the shards; nulls and repeated rows are
    kept as they are; an empty table has no shards and gives no rows.
    """
    spark = docs.sparkSession
    shards = ShardSet(spark, root or new_folder(spark, "shards"), target_bytes)
    shards.append(docs)
    shards.compact()
    files = sorted(s.path for s in shards.shards())
    schema = "doc_id long, shard int, position long, n_bytes long"
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(*files)
    names = spark.createDataFrame([(f.rsplit("/", 1)[1], k) for k, f in enumerate(files)], "name string, shard int")
    out = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"),
        F.col("_metadata.row_index").alias("position"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return out.join(names, "name").select("doc_id", "shard", "position", "n_bytes")
