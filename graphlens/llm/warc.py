"""WARC archives: writing one gzip member per record, and a splittable reader.

The reader cuts each archive into byte ranges. A task looks for gzip magic in
its range, accepts a candidate only if it inflates to a WARC header, keeps its
checksum and is followed by another member or the end of the file, and owns
the records that start inside its range; a record may end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
PREFIX = "urn:x-page:"
RECORDS = (
    "file string, offset bigint, page_id bigint, url string, record_type string, "
    "payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, intact boolean"
)


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _line(text: str | None) -> str:
    """A header value: control characters can't end the line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, and with it the payload's length."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        head += [
            f"WARC-Refers-To: <{PREFIX}{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0,
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write a record per row; returns the committed files (file, n_records, n_bytes).

    A null payload is empty and a null url an empty one. Among equal payloads
    of at least min_revisit_bytes the row with the smallest id is a response
    and the others are revisits; rows that repeat that same id, and rows
    without an id, are responses. Only files that the returned manifest names
    count: a task that is lost and runs again leaves an unnamed file behind.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    # digests alone are grouped; as a table of its own their join can be split at a hot digest, or be broadcast where it is small
    firsts = common.settle(
        rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n")
    )
    marked = rows.join(firsts, "sha", "left").select(
        "page_id", "url", "payload", "sha",
        F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        done, out, name, n, size = [], None, "", 0, 0
        fs.create_dir(base, recursive=True)

        def close():
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n, size))

        for batch in batches:
            for page_id, url, payload, sha, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size >= file_bytes:
                    close()
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = encode_record(page_id, url, payload, b32(sha), refers, refers is not None)
                out.write(member)
                n, size = n + 1, size + len(member)
        close()
        yield pa.RecordBatch.from_pydict(
            {"file": pa.array([d[0] for d in done], pa.string()),
             "n_records": pa.array([d[1] for d in done], pa.int64()),
             "n_bytes": pa.array([d[2] for d in done], pa.int64())}
        )

    return common.settle(
        marked.mapInArrow(write, "file string, n_records bigint, n_bytes bigint")
    )


class _Window:
    """Forward reads of a file through one buffered chunk."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.buf = f, size, 0, b""

    def read(self, pos: int) -> bytes:
        """Some bytes from pos on, none at the end."""
        if not self.at <= pos < self.at + len(self.buf):
            self.f.seek(pos)
            self.at, self.buf = pos, self.f.read(CHUNK)
        return self.buf[pos - self.at:]

    def exactly(self, pos: int, n: int) -> bytes:
        got = self.read(pos)[:n]
        while len(got) < n and (more := self.read(pos + len(got))):
            got += more[: n - len(got)]
        return got


def find_magic(w: _Window, pos: int, end: int) -> int:
    """The first gzip magic that starts in [pos, end), or -1."""
    while pos < end:
        got = w.read(pos)
        if not got:
            return -1
        if len(got) < len(MAGIC):
            got = w.exactly(pos, len(MAGIC))
        k = got.find(MAGIC)
        if k >= 0:
            return pos + k if pos + k < end else -1
        pos += max(1, len(got) - len(MAGIC) + 1)
    return -1


def decode_member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the WARC member at `at`; None if there is none."""
    z, pos, parts, head = zlib.decompressobj(31), at, [], b""
    try:
        while not z.eof:
            got = w.read(pos)
            if not got:
                return None
            got = got[:65536]
            part = z.decompress(got)
            pos += len(got)
            parts.append(part)
            if len(head) < 7:
                head += part[:7]
                if head and not b"WARC/1."[: len(head)] == head[:7]:
                    return None
    except zlib.error:
        return None
    end = pos - len(z.unused_data)
    if end < w.size and w.exactly(end, len(MAGIC)) != MAGIC:
        return None
    content = b"".join(parts)
    return (content, end) if content.startswith(b"WARC/1.") and b"\r\n\r\n" in content else None


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix(PREFIX)
    return int(tail) if tail.lstrip("-").isdigit() else None


def parse_record(content: bytes) -> tuple:
    head, _, rest = content.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h.get("content-length", 0))]
    kind = h.get("warc-type", "")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or "http" not in h.get("content-type", ""):
        http, payload = b"", block
    told = h.get("warc-payload-digest", "").rpartition(":")[2].upper()
    if kind == "revisit":
        return (_number(h.get("warc-record-id")), h.get("warc-target-uri"), kind, None,
                int(_headers(http).get("content-length", 0)), told, _number(h.get("warc-refers-to")), True)
    digest = b32(hashlib.sha1(payload).hexdigest())
    return (_number(h.get("warc-record-id")), h.get("warc-target-uri"), kind, payload, len(payload),
            digest, None, told in ("", digest))


def read_archives(files: DataFrame, split_bytes: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of the archives in files (file, n_bytes), in RECORDS' columns.

    Ranges of split_bytes are dealt evenly to a task for each task_bytes, or to
    as many tasks as there are cores, a range each, where that is more; their
    number is set, so that ranges, tiny as rows, aren't merged into one task.
    Payloads of responses are checked against their digest (intact). An empty
    or truncated archive gives the whole records it has.
    """
    cuts = files.where("n_bytes > 0").select(
        "file",
        F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"),
        "n_bytes",
    )
    ranges, total = files.where("n_bytes > 0").agg(
        F.sum(F.ceil(F.col("n_bytes") / split_bytes)), F.sum("n_bytes")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    cuts = cuts.repartition(int(max(1, min(ranges or 1, max(4 * cores, -(-(total or 0) // task_bytes))))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                 ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                 ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types]
            )

        for b in batches:
            for path, start, n_bytes in zip(*(c.to_pylist() for c in b.columns)):
                fs, local = _fs(path)
                with fs.open_input_file(local) as f:
                    w, pos, end = _Window(f, n_bytes), start, min(start + split_bytes, n_bytes)
                    while (at := find_magic(w, pos, end)) >= 0:
                        got = decode_member(w, at)
                        if got is None:
                            pos = at + 1
                            continue
                        rows.append((path, at, *parse_record(got[0])))
                        held += len(got[0])
                        pos = got[1]
                        if held > 8 << 20:
                            yield batch()
                            rows, held = [], 0
        yield batch()

    return cuts.mapInArrow(read, RECORDS)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes) of the archives under path; Spark lists them, nothing is read."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.col("length").alias("n_bytes")
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    files = write_archives(common.table(spark, sf_dir, "pages"), common.scratch(spark))
    return read_archives(files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: The digest's 40 hexadecimal digits are taken five at a time, each five giving four letters.
OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM m
"""
