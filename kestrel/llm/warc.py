"""WARC: write pages as archives, normalise monolithic gzip, read back by offset index.

*Write.* Each task writes its pages as one archive: a single gzip stream over all records, as
careless crawlers do, rolled after ``ROLL`` payload bytes. Payloads of at least ``min_bytes`` that occur more than
once are stored once: the row with the largest page_id is the response, the others are revisits
that refer to it (same digest, no payload).

*Normalise.* An archive is inflated once, as a stream; every record is written again as a gzip
member of its own, and a sidecar line per record gives offset, length, type, id, target and payload
digest. Memory is one record plus one buffer. Archives of many members, or a mixture, are
normalised in the same way.

*Read.* The sidecar is followed: each record is fetched by offset and length alone, its digest is
recomputed, and a mismatch raises.

Files go below the session's checkpoint folder (any scheme pyarrow opens). A task's files carry its
attempt number, and only the paths that successful attempts return are read on, so a lost
executor or a second attempt leaves no half-written archive in the result.

Defined cases: null html is an empty payload; a null url is written as an empty target and read
back as an empty string; rows with a null page_id are always responses and come back with a null
page_id; repeated rows come back as often (all rows with the largest id of a payload are
responses); an empty table writes no archive and returns no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import cut_lineage, ensure_checkpoint_dir, lean

ROLL = 256 << 20
BUFFER = 1 << 20
LEVEL = 1
MIN_BYTES = 1000
BROADCAST_ROWS = 100_000  # repeated payloads (under 100 bytes each) that every task may hold
DATE = "2020-01-01T00:00:00Z"
GZIP = 31  # zlib window bits for a gzip wrapper
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a folder or file, given with or without a scheme."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def record_id(page_id: int | None) -> str:
    """urn of a page's record; its first half says whether the page has an id."""
    h = f"{1 if page_id is None else 0:016x}{(page_id or 0) & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{uuid.UUID(h)}>"


def page_of(urn: str | None) -> int | None:
    if not urn:
        return None
    n = uuid.UUID(urn.strip("<>").rpartition(":")[2]).int
    low = n & (1 << 64) - 1
    return None if n >> 64 else low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    target = (url or "").encode("utf-8", "replace").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + record_id(page_id).encode(),
            b"WARC-Target-URI: " + target, b"WARC-Date: " + DATE.encode(), b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + record_id(refers_to).encode(),
                 b"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, a buffer at a time."""
    z = zlib.decompressobj(GZIP)
    while chunk := stream.read(BUFFER):
        while chunk:
            if z.eof:
                z = zlib.decompressobj(GZIP)
            out = z.decompress(chunk, BUFFER)
            if out:
                yield out
            chunk = z.unused_data if z.eof else z.unconsumed_tail
    if not z.eof:
        raise ValueError("archive ends inside a gzip member")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header block, whole record) one after the other; buffers grow to one record."""
    buf = bytearray()
    need, head_end = None, 0
    for chunk in chunks:
        buf += chunk
        start = 0
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                m = re.search(rb"\r\ncontent-length:\s*(\d+)", bytes(buf[start:end]), re.I)
                if not buf.startswith(b"WARC/", start) or not m:
                    raise ValueError("not a WARC record")
                head_end, need = end - start, end - start + 4 + int(m[1]) + 4
            if len(buf) - start < need:
                break
            whole = bytes(buf[start : start + need])
            yield whole[:head_end], whole
            start += need
            need = None
        del buf[:start]
    if buf:
        raise ValueError("archive ends inside a record")


def with_references(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    first = (rows.where(large & F.col("page_id").isNotNull()).groupBy("digest")
             .agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("keeper > least").drop("least"))
    first = cut_lineage(first)
    if first.count() <= BROADCAST_ROWS:  # then the payloads need no shuffle
        first = F.broadcast(first)
    other = large & (F.col("page_id") < F.col("keeper"))
    return (rows.join(first, "digest", "left")
            .select("page_id", "url", "payload", "digest", F.when(other, F.col("keeper")).alias("refers_to")))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of ``with_references`` rows below ``folder``: one row (path, n) per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, base = opened(folder)
        out, path, z, n, size, count = None, None, None, 0, 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out
            out.write(z.flush())
            out.close()
            done.append((path, n))
            out = None

        for batch in batches:
            for r in batch.to_pylist() if batch.nbytes < BUFFER else (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                if out is None:
                    count += 1
                    path = f"{base}/raw-{task.partitionId():05d}-{task.taskAttemptId()}-{count}.warc.gz"
                    where.create_dir(base, recursive=True)
                    out, z, n, size = where.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
                out.write(z.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])))
                n, size = n + 1, size + len(r["payload"])
                if size > ROLL:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([folder.rstrip("/") + p[len(base):] for p, _ in done], pa.string()),
                                          pa.array([c for _, c in done], pa.int64())], names=["path", "n"])

    return rows.mapInArrow(lean(run), "path string, n bigint")


def normalise(archives: DataFrame) -> DataFrame:
    """For each archive (column path) a copy with a member per record, and its index: (path, index, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for uri in batch.column(batch.schema.get_field_index("path")).to_pylist():
                where, src = opened(uri)
                stem = f"{re.sub(r'[.]warc[.]gz$', '', uri)}-{attempt}"
                target, index = opened(f"{stem}.members.warc.gz")[1], opened(f"{stem}.idx")[1]
                at = n = 0
                with (where.open_input_stream(src, compression=None) as stream, where.open_output_stream(target, compression=None) as out,
                      where.open_output_stream(index, compression=None) as idx):
                    for head, whole in split_records(inflated(stream)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        h = headers(head)
                        line = (at, len(member), h.get("warc-type", ""), h.get("warc-record-id", ""), h.get("warc-payload-digest", ""),
                                h.get("warc-target-uri", ""))
                        idx.write(("\t".join(str(x).replace("\t", "%09") for x in line) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{stem}.members.warc.gz"]), pa.array([f"{stem}.idx"]), pa.array([n], pa.int64())],
                                                 names=["path", "index", "n"])

    return archives.select("path").mapInArrow(lean(run), "path string, index string, n bigint")


def parse(whole: bytes) -> dict:
    """One inflated record as a row of ``RECORDS``."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    h = headers(head)
    http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest differs: {h['warc-record-id']}")
    return {"page_id": page_of(h["warc-record-id"]), "url": h["warc-target-uri"],
            "payload_bytes": int(headers(b"\r\n" + http.partition(b"\r\n")[2])["content-length"]), "payload_digest": digest,
            "record_type": h["warc-type"], "refers_to": page_of(h.get("warc-refers-to")),
            "payload": payload if h["warc-type"] == "response" else None}


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, fetched through their indexes (columns ``RECORDS``)."""
    names = [c.split(" ")[0] for c in RECORDS.split(", ")]
    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split(" ")[1]])
                        for n, c in zip(names, RECORDS.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, path = opened(uri)
                rows, size = [], 0
                with where.open_input_file(path) as data, where.open_input_stream(opened(index)[1], compression=None) as idx:
                    for line in _lines(idx):
                        at, length = line.split(b"\t")[:2]
                        data.seek(int(at))
                        row = parse(zlib.decompress(data.read(int(length)), GZIP))
                        size += row["payload_bytes"]
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        if len(rows) >= 4096 or (payloads and size > 8 * BUFFER):
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path", "index").mapInArrow(lean(run), RECORDS)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(BUFFER):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write, normalise and read back. The lists of archives are checkpointed: each file is written once."""
    spark = pages.sparkSession
    raw = cut_lineage(write(with_references(pages), folder or scratch(spark)))
    files = max(1, raw.count())
    whole = cut_lineage(normalise(raw.repartition(files)))
    return read(whole.repartition(files), payloads)


def op10(pages: DataFrame) -> DataFrame:
    return round_trip(pages.select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < keeper THEN keeper END AS refers_to FROM m
"""
