"""Operator 2: WARC archives, one gzip member per record, read back sequentially.

Equal payloads are stored once: the page with the largest id is a response, the
others are revisits that refer to it.  A revisit's block is the HTTP header
alone, whose Content-Length still tells the size of the full payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.scratch import dealt, new_folder, ship_package, stored, with_group

#: Compressed bytes from which a writer begins another archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that is cut short, misframed or does not have its digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(uri: str) -> int | None:
    last = uri.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {_DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else "%{:02X}".format(ord(c)) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"WARC-Block-Digest: sha1:{sha1_base32(block)}")
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def members(read) -> Iterator[bytes]:
    """Contents of consecutive gzip members; ``read(n)`` gives the next bytes, none at the end."""
    data = read(READ_BYTES)
    while data:
        coder, parts = zlib.decompressobj(31), []
        while not coder.eof:
            if not data:
                raise WarcError("the archive ends within a record")
            parts.append(coder.decompress(data))
            data = coder.unused_data if coder.eof else read(READ_BYTES)
        yield b"".join(parts)
        data = data or read(READ_BYTES)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; its frame and digests are verified."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise WarcError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError("a record does not have its content length")
    if headers["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise WarcError("a block does not have its digest")
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != "sha1:" + sha1_base32(block.partition(b"\r\n\r\n")[2]):
        raise WarcError("a payload does not have its digest")
    return headers, block


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        part, out, name, size, n = TaskContext.get().partitionId(), None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to, revisit = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))
                if out is None:
                    name, size, n = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip_member(record(page_id, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, revisit))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_warc(pages: DataFrame, folder: str, least_revisit: int = 0) -> DataFrame:
    """Write a record for each row to archives in ``folder``; returns the stored list (file, n_records).

    Of rows with equal payloads (of at least ``least_revisit`` bytes) the one with
    the largest page_id is a response (repeated rows with it are responses too),
    the others revisit it.  A null html is an empty payload; a null page_id is
    less than any; a null url is left out; an empty table writes no archive.
    """
    ship_package(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    joined = with_group(rows, stored(groups, "payloads"), "digest", "n", "page_id")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    records = joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))
    return stored(records.mapInArrow(_write(folder), "file string, n_records long"), "archives")


def read_records(read) -> Iterator[dict]:
    """Records of one archive as rows: page_id, url, payload (None of a revisit) and what the query returns."""
    for data in members(read):
        headers, block = parse(data)
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        kind = headers["warc-type"]
        yield {
            "page_id": _page(headers["warc-record-id"]),
            "url": headers.get("warc-target-uri"),
            "payload": payload if kind == "response" else None,
            "payload_bytes": length,
            "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": kind,
            "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None,
        }


_READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str, payloads: bool):
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(kinds + [("url", pa.string()), ("payload", pa.binary())] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for row in read_records(f.read):
                        rows.append(row)
                        held += row["payload_bytes"] if payloads else 64
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Rows of all records in the listed archives, each read from start to end, as many side by side as there are tasks."""
    ship_package(archives.sparkSession)
    extra = ", url string, payload binary" if payloads else ""
    return dealt(archives.select("file")).mapInArrow(_read(folder, payloads), _READ_SCHEMA + extra)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder, payloads=False)
