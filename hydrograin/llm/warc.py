"""WARC archives: segmented, chunked, deduplicated records written by tasks, and their reassembly.

Writing: each page becomes a response record, or a revisit of the page that keeps the same payload. The
HTTP body is sent in chunks; a block above SEGMENT bytes is cut into a first record and continuation
records. Every task writes archives of bounded size into a shared folder and returns their names; the
table of names is committed by Spark, so that files of lost or repeated tasks are never read.

Reading: records are parsed from the archives; those of several segments are grouped by origin id, ordered
by segment number and checked against the total length; then the chunks are decoded and the digest checked.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, new_folder, read_table, spread, stage

#: Bytes of a record's block before it goes on in a continuation record, and of one HTTP chunk.
SEGMENT, CHUNK = 16_384, 4_096
#: Compressed bytes after which a task starts the next archive; a reading task holds one archive at a time.
ARCHIVE = 16_000_000
#: Bytes that a reader hands on at a time: what a member leaves of these is handed on again.
STEP = 8_192
#: Payloads below this many bytes are never revisits.
LEAST = 1_000

_PIECE = "origin string, number int, total long, page_id long, kind string, refers_to long, length long, digest string, block binary"
_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; ValueError if it is cut off or malformed."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        part = framed[end + 2 : end + 2 + size]
        if len(part) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk cut off")
        if not size:
            return b"".join(parts)
        parts.append(part)
        at = end + 4 + size


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": len(block)}.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _gz(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int) -> Iterator[bytes]:
    """The WARC records of one page, each a gzip member."""
    digest = hashlib.sha1(payload).hexdigest()
    origin = f"<urn:page:{page_id}:{digest}>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    fields = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": re.sub(r"\s", "%20", url or "urn:none"), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "X-Page": page_id, "X-Copy": copy}
    if refers_to is not None:
        fields |= {"WARC-Type": "revisit", "WARC-Record-ID": origin, "WARC-Refers-To": f"<urn:page:{refers_to}:{digest}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield _gz(_record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload)))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    first = fields | {"WARC-Type": "response", "WARC-Record-ID": origin, "WARC-Segment-Number": 1 if len(parts) > 1 else None}
    yield _gz(_record(first, parts[0]))
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield _gz(_record({"WARC-Type": "continuation", "WARC-Record-ID": f"{origin[:-1]}:{n}>", "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": total, "X-Copy": copy}, part))


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive of gzip members."""
    rest_of, at = memoryview(archive), 0
    while at < len(rest_of):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not (piece := rest_of[at : at + STEP]):
                raise ValueError("the archive's last member is cut off")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def references(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of every revisit: of equal payloads of LEAST bytes or more the largest page_id is kept."""
    small = pages.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).where(F.col("n") >= LEAST).select("page_id", "digest")
    kept = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to")
    return small.join(kept.select("digest", "refers_to").repartition(F.xxhash64("refers_to")), "digest").where("page_id < refers_to").distinct()


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record per row (page_id, url, html) and return the committed table (archive, records).

    A null html counts as empty, a null url as urn:none. Rows without a page_id are always responses, and so
    are all rows that share the kept page_id and payload.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    of = stage(references(rows))
    rows = rows.withColumn("digest", F.sha1("payload")).join(of, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to", F.monotonically_increasing_id().alias("copy"))
    folder = new_folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        out, name, n, size = None, "", 0, 0
        done = []
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for row in b.slice(at, 64).to_pylist():
                    for member in records(row["page_id"], row["url"], row["payload"], row["refers_to"], row["copy"]):
                        if out is None:
                            name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                            out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(member)
                        n, size = n + 1, size + len(member)
                        if size >= ARCHIVE:
                            out.close()
                            done.append((name, n))
                            out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["archive", "records"])

    return stage(rows.mapInArrow(write, "archive string, records long"))


def _piece(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(v) if (v := fields.get(k, "None")) != "None" else None
    refers = re.match(r"<urn:page:(-?\d+):", fields.get("WARC-Refers-To", ""))
    origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]) + fields.get("X-Copy", "")
    length = re.search(rb"\r\nContent-Length: (\d+)\r\n", block) if fields["WARC-Type"] == "revisit" else None
    return (
        origin, number("WARC-Segment-Number"), number("WARC-Segment-Total-Length"), number("X-Page"), fields["WARC-Type"],
        int(refers[1]) if refers else None, int(length[1]) if length else None, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), block,
    )


def _page(page_id: int | None, kind: str, refers_to: int | None, length: int | None, digest: str, block: bytes) -> tuple:
    if kind == "revisit":
        return page_id, length, digest, kind, refers_to, None
    payload = dechunked(block.partition(b"\r\n\r\n")[2])
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"page {page_id}: the payload does not match its digest")
    return page_id, len(payload), digest, kind, refers_to, payload


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


_PIECES = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("refers_to", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
_PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per page from the table of archives: id, payload and its figures; the payload of a revisit is null.

    Fails on a missing segment, a wrong total length, broken framing or a wrong digest.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = filesystem(name)
                with fs.open_input_stream(path, compression=None) as f:
                    archive = f.read()
                held, size = [], 0
                for fields, block in parsed(archive):
                    held.append(_piece(fields, block))
                    size += len(block)
                    if size > 4_000_000:
                        yield _batch(held, _PIECES)
                        held, size = [], 0
                if held:
                    yield _batch(held, _PIECES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = [_page(r["page_id"], r["kind"], r["refers_to"], r["length"], r["digest"], r["block"]) for r in b.slice(at, 256).to_pylist()]
                if rows:
                    yield _batch(rows, _PAGES)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                rows = []
                for parts in b.slice(at, 16).column(0).to_pylist():
                    block = b"".join(p["block"] for p in parts)
                    total = [p["total"] for p in parts if p["total"] is not None]
                    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total != [len(block)]:
                        raise ValueError(f"page {parts[0]['page_id']}: segments are missing")
                    rows.append(_page(parts[0]["page_id"], parts[0]["kind"], None, None, parts[0]["digest"], block))
                if rows:
                    yield _batch(rows, _PAGES)

    found = spread(archives.select("archive")).mapInArrow(pieces, _PIECE)
    single = found.where("number IS NULL").mapInArrow(whole, _PAGE)
    segments = found.where("number IS NOT NULL").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "total", "page_id", "kind", "digest", "block"))).alias("parts")
    )
    return single.unionByName(segments.select("parts").mapInArrow(assembled, _PAGE))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(write_archives(read_table(spark, sf_dir, "pages")))
    return found.drop("payload")


QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM k"""
}
