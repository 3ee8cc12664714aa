"""FASTA and FASTQ files as tables, and back.

Plain files are split between tasks: a FASTA record is one delimited row, and
FASTQ lines are numbered through the file and put together in fours.  Compressed
files are one task each.  Reads keep their place in the file as ``seq_no``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.alphabet import ALPHABETS
from strandlake.tables import ship_package, stored

_BLOCK = ["__path", "__block"]
_FASTQ = (".fq", ".fastq")
_COMPRESSED = (".gz", ".bz2")


def is_fastq(path: str) -> bool:
    name = path.lower()
    for end in _COMPRESSED:
        name = name.removesuffix(end)
    return name.endswith(_FASTQ)


def _numbered(rows: DataFrame, label: str) -> DataFrame:
    """rows with ``__n``: the row's place in its file.

    A block of a file is read in order by one task, so places follow from the
    counts of the blocks before; only the counts are sorted.
    """
    rows = rows.select("value", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    rows = stored(rows, label)
    blocks = rows.groupBy(*_BLOCK).agg(F.count("*").alias("__rows"), F.min("__id").alias("__least"))
    blocks = blocks.selectExpr("*", "sum(__rows) over (partition by __path order by __block) - __rows as __before")
    return rows.join(blocks, _BLOCK).withColumn("__n", F.col("__before") + F.col("__id") - F.col("__least")).select("value", "__path", "__n")


def _names(header: Column) -> list[Column]:
    """(name, comment): a header up to its first blank, and the rest; no comment is null."""
    rest = F.regexp_extract(header, r"^[^ \t]*[ \t](.*)$", 1)
    return [F.regexp_extract(header, r"^[^ \t]*", 0).alias("name"), F.when(header.rlike("[ \t]"), rest).alias("comment")]


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    rows = _numbered(spark.read.text(path, lineSep="\n>"), "fasta")
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    rows = rows.select("__path", "__n", F.substring_index(text, "\n", 1).alias("h"), text.alias("t")).where("t <> ''")
    sequence = F.replace(F.substr("t", F.length("h") + 2), F.lit("\n"), F.lit(""))
    return rows.select("__path", F.col("__n").alias("seq_no"), *_names(F.col("h")), sequence.alias("sequence"), F.lit(None).cast("string").alias("quality"), F.lit(True).alias("framed"))


def _fastq(spark: SparkSession, path: str) -> DataFrame:
    lines = _numbered(spark.read.text(path), "fastq").withColumn("value", F.regexp_replace("value", "\r$", ""))
    line = lambda i: F.max(F.when(F.col("__n") % 4 == i, F.col("value")))
    rows = lines.groupBy("__path", F.floor(F.col("__n") / 4).alias("seq_no")).agg(*[line(i).alias(f"l{i}") for i in range(4)])
    rows = rows.where("not (coalesce(l0, '') = '' and l1 is null)").where("coalesce(l0, '') <> '' or coalesce(l1, '') <> ''")
    framed = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    header = F.substr("l0", F.lit(2))
    return rows.select("__path", "seq_no", *_names(header), F.col("l1").alias("sequence"), F.col("l3").alias("quality"), F.coalesce(framed, F.lit(False)).alias("framed"))


def _wrapped_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines in order, a file after the other: a sequence runs to the line that starts with +, a quality as long as the sequence."""
    rows, state = [], None

    def close() -> None:
        path, n, head, seq, qual, _ = state
        s, q = "".join(seq), "".join(qual)
        rows.append((path, n, head, s, q, head.startswith("@") and len(q) == len(s)))

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["__path", "seq_no", "head", "sequence", "quality", "framed"])

    for batch in batches:
        for path, value in zip(batch.column("__path").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if state is not None and state[0] != path:
                close()
                state, n = None, 0
            elif state is None:
                n = 0
            if state is None:
                if value:
                    state = [path, n, value, [], [], False]
                continue
            size = sum(map(len, state[3]))
            if state[5] and (sum(map(len, state[4])) >= size) and (value.startswith("@") or not value):
                n = state[1] + 1
                close()
                state = [path, n, value, [], [], False] if value else None
                if state is None:
                    state = [path, n, "", [], [], False]
            elif state[2] == "":
                state[2] = value
            elif not state[5] and value.startswith("+"):
                state[5] = True
            else:
                state[4 if state[5] else 3].append(value)
        if rows:
            yield out()
            rows.clear()
    if state is not None and state[2]:
        close()
    if rows:
        yield out()


def _wrapped_fastq(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ whose sequences and qualities take several lines: where a record ends depends on what came before, so a file is one ordered task."""
    ship_package(spark.range(0))
    lines = _numbered(spark.read.text(path), "fastq").withColumn("value", F.regexp_replace("value", "\r$", ""))
    rows = lines.repartition("__path").sortWithinPartitions("__path", "__n").select("__path", "value")
    rows = rows.mapInArrow(_wrapped_records, "__path string, seq_no long, head string, sequence string, quality string, framed boolean")
    return rows.select("__path", "seq_no", *_names(F.substr("head", F.lit(2))), "sequence", "quality", "framed")


def scan_fastx(spark: SparkSession, path: str, alphabet: str = "DNA", min_length: int = 0, sample: str | None = None, kind: str | None = None) -> DataFrame:
    """Every record of a file or folder: sample, seq_no, name, comment, sequence, quality, status.

    status: ``ok``, ``short`` (below min_length), ``symbol`` (not of the alphabet)
    or ``format`` (a FASTQ record out of frame, or with a quality of other length).
    FASTQ records have four lines; those of ``wrapped`` ones have more, and such a
    file is not split.  An empty file has no records.  kind: ``fasta``, ``fastq``
    or ``wrapped``; by default the path's suffix decides between the first two.
    """
    kind = kind or ("fastq" if is_fastq(path) else "fasta")
    rows = {"fasta": _fasta, "fastq": _fastq, "wrapped": _wrapped_fastq}[kind](spark, path)
    letters = ALPHABETS[alphabet]
    status = (
        F.when(~F.col("framed"), "format").when(~letters.is_valid(F.col("sequence")), "symbol").when(F.length("sequence") < min_length, "short").otherwise("ok")
    )
    name = F.lit(sample) if sample is not None else F.element_at(F.split("__path", "/"), -1)
    return rows.select(name.alias("sample"), "seq_no", "name", "comment", F.upper("sequence").alias("sequence"), "quality", status.alias("status"))


def read_fastx(spark: SparkSession, path: str, alphabet: str = "DNA", strict: bool = False, min_length: int = 0, sample: str | None = None, kind: str | None = None) -> DataFrame:
    """Valid reads: sample, seq_no, name, comment, sequence, quality.

    Others are skipped; with ``strict`` an invalid symbol or format is an error.
    """
    rows = scan_fastx(spark, path, alphabet, min_length, sample, kind)
    if strict:
        bad = F.col("status").isin("symbol", "format")
        message = F.concat(F.lit("invalid record "), F.coalesce("name", F.lit("")), F.lit(": "), F.col("status"))
        rows = rows.withColumn("status", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("status")))
    return rows.where("status = 'ok'").drop("status")


def scan_counts(scan: DataFrame) -> DataFrame:
    """(n_parsed, n_skipped) of a scan."""
    return scan.agg(F.count_if(F.col("status") == "ok").alias("n_parsed"), F.count_if(F.col("status") != "ok").alias("n_skipped"))


def read_samples(spark: SparkSession, inputs: Sequence[str], mode: str = "single", names: Sequence[str] | None = None, **options) -> DataFrame:
    """Reads of several samples, with ``mate``: 0 for single reads, 1 and 2 for pairs.

    mode ``single``: a sample for each input; ``interleaved``: mates take turns in
    each input; ``split``: inputs come in twos, left and right.
    """
    if mode not in ("single", "interleaved", "split"):
        raise ValueError(f"unknown pairing mode {mode}")
    step = 2 if mode == "split" else 1
    if len(inputs) % step or not inputs:
        raise ValueError("split pairs need an even number of inputs" if inputs else "no inputs")
    groups = [inputs[i : i + step] for i in range(0, len(inputs), step)]
    names = list(names) if names is not None else [sample_name(g) for g in groups]
    if len(names) != len(groups):
        raise ValueError("as many names as samples are needed")
    out = None
    for name, group in zip(names, groups, strict=True):
        for side, path in enumerate(group):
            rows = read_fastx(spark, path, sample=name, **options)
            if mode == "interleaved":
                rows = rows.withColumn("mate", (F.col("seq_no") % 2 + 1).cast("int")).withColumn("seq_no", F.floor(F.col("seq_no") / 2))
            else:
                rows = rows.withColumn("mate", F.lit(side + 1 if mode == "split" else 0))
            out = rows if out is None else out.unionByName(rows)
    return out


def sample_name(paths: Sequence[str]) -> str:
    """What the base names of a sample's files have in common, without suffixes."""
    stems = []
    for path in paths:
        stem = path.rstrip("/").rsplit("/", 1)[-1]
        for end in (*_COMPRESSED, ".fasta", ".fastq", ".fa", ".fq"):
            stem = stem.removesuffix(end)
        stems.append(stem)
    common = stems[0]
    while not all(s.startswith(common) for s in stems):
        common = common[:-1]
    return common.rstrip("._-") or stems[0]


# --- mates


def is_left(name: Column, comment: Column) -> Column:
    return name.endswith("/1") | F.coalesce(comment.startswith("1:"), F.lit(False))


def is_right(name: Column, comment: Column) -> Column:
    return name.endswith("/2") | F.coalesce(comment.startswith("2:"), F.lit(False))


def is_pair(left: Column, left_comment: Column, right: Column, right_comment: Column) -> Column:
    """Whether two names are mates: ``x/1`` and ``x/2``, or one name with comments of sides 1 and 2."""
    stem = lambda c: F.regexp_replace(c, "/[12]$", "")
    slashes = left.endswith("/1") & right.endswith("/2") & (stem(left) == stem(right))
    sides = left_comment.startswith("1:") & right_comment.startswith("2:")
    ends = left_comment.endswith("/1") & right_comment.endswith("/2") & (stem(left_comment) == stem(right_comment))
    return slashes | ((left == right) & F.coalesce(sides | ends, F.lit(False)))


_MATE = ("name", "comment", "sequence", "quality")


def paired(left: DataFrame, right: DataFrame, strict: bool = False, force_name_match: bool = False) -> DataFrame:
    """(sample, seq_no, left, right) of reads at the same place of two files; ``left`` or ``right`` is null where that read was skipped.

    A file that ends before the other is an error: the last places of both must
    agree (``left`` and ``right`` are scans with ``status``, or valid reads, whose
    last ones then count).  force_name_match drops pairs whose names do not match, or raises with ``strict``.
    """
    ok = lambda df: df.where("status = 'ok'") if "status" in df.columns else df
    side = lambda df, name: ok(df).select("sample", "seq_no", F.struct(*_MATE).alias(name))
    rows = side(left, "left").join(side(right, "right"), ["sample", "seq_no"], "full")
    if "status" in left.columns and "status" in right.columns:
        last = lambda df, name: df.groupBy("sample").agg(F.max("seq_no").alias(name))
        ends = last(left, "__l").join(last(right, "__r"), "sample", "full")
        uneven = ~F.col("__l").eqNullSafe(F.col("__r"))
        ends = ends.select("sample", F.when(uneven, F.raise_error(F.lit("one mate file ends before the other")).cast("boolean")).otherwise(F.lit(True)).alias("__even"))
        rows = rows.join(F.broadcast(ends), "sample", "left").where(F.coalesce("__even", F.lit(True))).drop("__even")  # one row a sample
    if force_name_match:
        match = F.coalesce(is_pair(F.col("left.name"), F.col("left.comment"), F.col("right.name"), F.col("right.comment")), F.lit(False))
        whole = F.col("left").isNotNull() & F.col("right").isNotNull()
        if strict:
            match = F.when(whole & ~match, F.raise_error(F.lit("names of mates do not match")).cast("boolean")).otherwise(F.lit(True))
        rows = rows.where(~whole | match)
    return rows


def interleaved(pairs: DataFrame) -> DataFrame:
    """(sample, seq_no, mate, *read): left, then right of each pair."""
    both = F.array(F.struct(F.lit(1).alias("mate"), F.col("left").alias("r")), F.struct(F.lit(2).alias("mate"), F.col("right").alias("r")))
    return pairs.select("sample", "seq_no", F.explode(both).alias("x")).where("x.r is not null").select("sample", "seq_no", "x.mate", "x.r.*")


# --- sinks


def record_text(name: Column, sequence: Column, quality: Column) -> Column:
    """FASTQ with a quality, FASTA without; no newline at the end."""
    fasta = F.concat(F.lit(">"), name, F.lit("\n"), sequence)
    return F.when(quality.isNull(), fasta).otherwise(F.concat(F.lit("@"), name, F.lit("\n"), sequence, F.lit("\n+\n"), quality))


def write_fastx(df: DataFrame, path: str, order: Sequence[str] = ("seq_no",), compression: str = "none") -> None:
    """A folder of part files that, by name, hold the reads in order."""
    quality = F.col("quality") if "quality" in df.columns else F.lit(None).cast("string")
    name = F.col("name") if "name" in df.columns else F.col("seq_no").cast("string")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(record_text(name, F.col("sequence"), quality).alias("value")).write.text(path, compression=compression)
