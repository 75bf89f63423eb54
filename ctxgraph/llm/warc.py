"""WARC archives: a writer and a sequential reader.

Every record is one gzip member.  The reader decompresses member after member
with zlib in chunks, frames the record by its Content-Length and verifies block
and payload digests.  Records of equal payload are stored once: the one of the
largest id as a response, the others as revisits of it.

Which payloads are met twice is settled on digests (a map-side combined
aggregation that keeps groups of two or more only); the join back to the pages
is a plain left join on the digest, so Catalyst broadcasts the groups where
they are small and splits hot digests where they are not.  A revisit carries no
payload.  Writers and readers run one file at a time per task; files are closed
at ``file_bytes`` and listed in a table of finished files, so a file of a lost
or repeated task attempt is never read.

Defined results: null html is empty; rows of one id and payload are alike; a
null id is smaller than any, so it is a response only among null ids; a null
url is ``urn:null``; further columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, tune

FILE_BYTES, CHUNK = 64 << 20, 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ = "path string, n long, record_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_uri(uri: str) -> str:
    """``uri`` fit for a header line: control characters, and spaces at its ends,
    are percent-encoded, so that no address can end a line or bear a header."""
    quote = lambda m: "".join(f"%{b:02X}" for b in m[0].encode())
    return re.sub(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]|^\s+|\s+$", quote, uri)


def record(record_id: str, uri: str, payload: bytes, sha1: str, refers_to: str | None = None) -> bytes:
    """One record, not compressed: a response, or a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe_uri(uri)}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class BadRecord(ValueError):
    """A record that cannot be framed or does not match its digests."""


def members(stream, chunk: int = CHUNK):
    """The content of each gzip member, decompressed in pieces as it is read."""
    held = b""
    while True:
        data = held or stream.read(chunk)
        if not data:
            return
        z, out, held = zlib.decompressobj(31), [], b""
        try:
            while True:
                out.append(z.decompress(data))
                if z.eof:
                    held = z.unused_data
                    break
                data = stream.read(chunk)
                if not data:
                    raise BadRecord("the file ends within a member")
        except zlib.error as e:
            raise BadRecord(f"not a gzip member: {e}") from e
        yield b"".join(out)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse(data: bytes) -> dict:
    """The record in one member; raises BadRecord."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise BadRecord("no WARC header")
    h = _fields(lines[1:])
    try:
        n = int(h["content-length"])
    except (KeyError, ValueError):
        raise BadRecord("no Content-Length") from None
    block = rest[:n]
    if n < 0 or len(block) != n or rest[n:] != b"\r\n\r\n":
        raise BadRecord("the block and its Content-Length differ")
    got = h.get("warc-block-digest", "").removeprefix("sha1:")
    if got and got != digest32(block):
        raise BadRecord("block digest")
    payload, size, kind = block, n, h.get("warc-type", "")
    if h.get("content-type", "").startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise BadRecord("no HTTP header")
        size = len(payload)
        if kind == "revisit":  # the length of the payload that is not here
            size = int(_fields(http.split(b"\r\n")[1:]).get("content-length", "0"))
    want = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and want and want != digest32(payload):
        raise BadRecord("payload digest")
    bare = lambda x: x.strip("<>") if x else None
    return {
        "record_id": bare(h.get("warc-record-id")), "target_uri": h.get("warc-target-uri"), "record_type": kind, "refers_to": bare(h.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": want or digest32(payload), "payload": None if kind == "revisit" else payload,
    }


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Archive ``pages`` under ``folder`` (a URI that pyarrow can write) and
    return the table of files: path, records, bytes."""
    spark = pages.sparkSession
    tune(spark)
    if not isinstance(pages.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{key} must be a whole number: records are named by it")
    scratch = scratch or Scratch(spark, "warc")
    body = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.sha1(body).alias("sha1"))
    groups = rows.groupBy("sha1").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha1").alias("of"), "last")
    groups = scratch.keep(groups)
    rows = rows.join(groups, F.col("sha1") == F.col("of"), "left")
    other = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("id"))
    rows = rows.select("id", "url", F.when(~other, F.col("html")).alias("html"), F.octet_length("html").alias("size"), "sha1", F.when(other, F.col("last")).alias("first"))
    name = lambda x: f"urn:page:{'null' if x is None else x}"

    def run(batches):
        where, base = fs.FileSystem.from_uri(folder)
        attempt = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, path, n, size, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n, size))
                out = None

        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page, uri, payload, full, sha1, first = (c[i].as_py() for c in cols)
                if out is None:
                    path, n, size = f"{base}/{attempt}-{len(done):04d}.warc.gz", 0, 0
                    out = where.open_output_stream(path, compression=None)
                sha = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(name(page), uri or "urn:null", payload if first is None else bytes(0), sha) if first is None else _revisit(name(page), uri or "urn:null", full, sha, name(first))
                data = gzip_member(data)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    return scratch.keep(rows.mapInArrow(run, "path string, records long, bytes long"))


def _revisit(record_id: str, uri: str, size: int, sha1: str, refers_to: str) -> bytes:
    """A revisit's record: the header has the payload's length and digest."""
    data = record(record_id, uri, b"", sha1, refers_to)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    old, new = http % 0, http % size
    data = data.replace(old, new).replace(f"sha1:{digest32(old)}".encode(), f"sha1:{digest32(new)}".encode())
    return data.replace(b"\r\nContent-Length: %d\r\n\r\nHTTP" % len(old), b"\r\nContent-Length: %d\r\n\r\nHTTP" % len(new))


def read(spark: SparkSession, files: DataFrame, folder: str, payload: bool = True, on_error: str = "raise") -> DataFrame:
    """A row per record of ``files(path)``, in the order of each file (``n``).

    A record that fails is an error, or with ``on_error="mark"`` a row whose
    ``error`` says why; a file is given up where its framing is lost."""
    if on_error not in ("raise", "mark"):
        raise ValueError(on_error)
    tune(spark)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in READ.split(", ")]

    def batch_of(rows):
        types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    def run(batches):
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held, n = [], 0, 0
                with where.open_input_stream(path, compression=None) as stream:
                    found = members(stream)
                    while True:
                        try:
                            data = next(found, None)
                            if data is None:
                                break
                            row = parse(data)
                        except BadRecord as e:
                            if on_error == "raise":
                                raise BadRecord(f"{path}, record {n}: {e}") from e
                            row = {"error": str(e)}
                        if not payload:
                            row["payload"] = None
                        rows.append(row | {"path": path, "n": n})
                        n, held = n + 1, held + len(row.get("payload") or b"") + 300
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return files.select("path").repartition(count).mapInArrow(run, READ)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive ``pages`` and read the archives back: key, payload_bytes,
    payload_digest, record_type and refers_to (a key)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/archives"
    folder = folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:"))
    files = write(pages, folder, key, url, html, scratch=scratch)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    back = read(spark, files, folder, payload=False)
    return back.select(number(F.col("record_id")).alias(key), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
m AS (SELECT s, max(page_id) AS last FROM h GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, 10 * (i // 8) + 1, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h JOIN m USING (s)
"""
