"""Legacy ARC archives to WARC.

An ARC file opens with a version block that names the version and the fields of all later header lines: version 1 has
``URL IP-address Archive-date Content-type Archive-length``, version 2 adds result code, checksum, location, offset and
file name before the length. A record is such a line and as many bytes as it declares. The converter reads the fields by
the file's version, takes contents by their declared length (never by looking for separators, which contents may
imitate), and synthesises what WARC wants and ARC lacks: record types, record identifiers, ISO dates, content types,
block and payload digests, and revisit records for payloads already seen.

Files are written by Spark's text writer (a WARC record ends with a line feed, so a record is one "line") and read back
as binary files, so any store that Spark reaches will do. A file holds what one task wrote.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm.shared import attach, stored
from candora.plans.storage import scratch_path

ARC_FIELDS = {  # fixed values: header fields of the two versions of the format
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
PAGE_HEADER = b"X-Page-Id"
LEAST_PAYLOAD = 100  # shorter payloads are stored again rather than referred to
OUT_BYTES = 4 << 20  # payload bytes per batch handed back to Spark


def _clean_url(url: str | None, number: object) -> bytes:
    """A URL without white space and control characters, as header lines need it."""
    text = url if url else f"urn:page:{number}"
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in text.encode("utf-8", "surrogatepass"))


def arc_header(version: int, url: bytes, date: str, mime: str, length: int, status: int = 200) -> bytes:
    """Header line of an ARC record."""
    middle = b"" if version == 1 else b"%d - - 0 pages.arc " % status
    return b"%s 0.0.0.0 %s %s %s%d" % (url, date.encode(), mime.encode(), middle, length)


def arc_version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 Candora\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(version, b"filedesc://pages.arc", date, "text/plain", len(body)) + b"\n" + body


def http_response(payload: bytes, page_id: int | None) -> bytes:
    own = b"" if page_id is None else b"%s: %d\r\n" % (PAGE_HEADER, page_id)
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (own, len(payload)) + payload


def _open(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)


def read_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file after its version block: ``offset``, ``version``, ``url``, ``ip``, ``date``, ``mime``, ``block``.

    A header line with too few fields, or a file that ends inside a record, is an error: guessing would shift contents.
    """
    source, offset, version = _open(content), 0, 0
    while line := source.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        fields = len((ARC_FIELDS[version] if version else ARC_FIELDS[2 if len(line.split(b" ")) >= 10 else 1]).split(" "))
        parts = line.rstrip(b"\r\n").rsplit(b" ", fields - 1)  # a URL may hold blanks, the other fields can't
        if len(parts) != fields or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line at {start}: {line[:80]!r}")
        size = int(parts[-1])
        block = source.read(size)
        if len(block) != size:
            raise ValueError(f"the record at {start} declares {size} bytes, the file has {len(block)}")
        offset += size
        if parts[0].startswith(b"filedesc://"):
            version = int(block.split(b"\n", 1)[0].split(b" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        if not version:
            raise ValueError("the file does not begin with a version block")
        yield {
            "offset": start, "version": version, "url": parts[0].decode("utf-8", "replace"), "ip": parts[1].decode(),
            "date": parts[2].decode(), "mime": parts[3].decode("utf-8", "replace"), "block": block,
        }


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Status line and headers (with the empty line), and the payload; no headers if it isn't an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def _page_of(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name == PAGE_HEADER:
            return int(value)
    return None


def iso_date(date: str) -> str:
    """``YYYYMMDDhhmmss`` (or its beginning) as an ISO instant."""
    d = (date + "19700101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def warc_record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A whole WARC record but for its last line feed, which Spark's writer adds."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest())]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r"


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a WARC file."""
    source = _open(content)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = source.read(size)
        if len(block) != size:
            raise ValueError("the file ends inside a record")
        yield headers, block


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names)

    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _write(records: DataFrame, path: str) -> None:
    """Write a binary column as files, each value followed by a line feed."""
    records.select(F.col("value").cast("string")).write.option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240229000000") -> None:
    """Write pages as ARC files; odd tasks write version 1, even ones version 2."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 0

        def rows() -> Iterator[tuple]:
            nonlocal version
            for batch in batches:
                for number in range(0, batch.num_rows, 500):
                    part = batch.slice(number, 500)
                    for page, url, html, task in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if not version:
                            version = 1 + (task + 1) % 2
                            yield (arc_version_block(version, date),)
                        block = http_response((html or "").encode("utf-8", "surrogatepass"), page)
                        yield (arc_header(version, _clean_url(url, page), date, "text/html", len(block)) + b"\n" + block,)

        yield from _batched(rows(), ["value"], [pa.binary()])

    chosen = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    _write(chosen.withColumn("_task", F.spark_partition_id()).mapInArrow(work, "value binary"), path)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arc_records(spark, path: str, payload: bool) -> DataFrame:
    """Records of all ARC files below ``path`` with size and digest of their payload, and on demand their block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    name, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    for r in read_arc(content):
                        head, body = split_http(r["block"])
                        yield (
                            name, r["offset"], _page_of(head), r["url"], r["ip"], r["date"], r["mime"], len(body),
                            hashlib.sha256(body).hexdigest(), r["block"] if payload else None,
                        )

        names = ["file", "offset", "page", "url", "ip", "date", "mime", "size", "digest", "block"]
        text, number = pa.string(), pa.int64()
        yield from _batched(rows(), names, [text, number, number, text, text, text, text, number, text, pa.binary()])

    return _files(spark, path).mapInArrow(
        work, "file string, offset long, page long, url string, ip string, date string, mime string, size long, digest string, block binary"
    )


def convert(spark, arc_path: str, warc_path: str, least: int = LEAST_PAYLOAD) -> None:
    """Convert all ARC files below ``arc_path`` to WARC files below ``warc_path``.

    Of records with equal payloads of at least ``least`` bytes, the first (by page number where the records carry one,
    then file and offset) is stored and the others become revisits of it. Equal payloads are found by SHA-256.
    """
    found = stored(arc_records(spark, arc_path, payload=False).drop("block"), "arc")
    order = F.struct(F.coalesce("page", F.lit((1 << 63) - 1)).alias("p"), "file", "offset", "url", "date")
    groups = found.filter(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = groups.filter("_n > 1")
    marked = attach(found.filter(F.col("size") >= least), groups, ["digest"], "_n", ["file", "offset"])
    # only what refers elsewhere; all other records are stored
    other = (F.col("_first.file") != F.col("file")) | (F.col("_first.offset") != F.col("offset"))
    revisits = marked.filter(F.col("_first").isNotNull() & other).select("file", "offset", "_first")
    joined = arc_records(spark, arc_path, payload=True).join(revisits, ["file", "offset"], "left")
    flat = joined.select(
        "file", "offset", "url", "ip", "date", "mime", "size", "digest", "block", F.col("_first.p").alias("to_page"),
        F.col("_first.file").alias("to_file"), F.col("_first.offset").alias("to_offset"),
        F.col("_first.url").alias("to_url"), F.col("_first.date").alias("to_date"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            started = False
            for batch in batches:
                for low in range(0, batch.num_rows, 200):
                    for r in batch.slice(low, 200).to_pylist():
                        if not started:
                            started = True
                            about = b"software: candora\r\nformat: WARC File Format 1.1\r\n"
                            yield (
                                warc_record(
                                    "warcinfo",
                                    [("WARC-Record-ID", record_id(f"info {r['file']} {r['offset']}")), ("WARC-Date", iso_date(r["date"])), ("Content-Type", "application/warc-fields")],
                                    about,
                                ),
                            )
                        yield (_warc_of(r),)

        yield from _batched(rows(), ["value"], [pa.binary()])

    _write(flat.mapInArrow(work, "value binary"), warc_path)


def _warc_of(r: dict) -> bytes:
    head, _ = split_http(r["block"])
    headers: list[tuple[str, object]] = [
        ("WARC-Record-ID", record_id(f"{r['file']} {r['offset']}")),
        ("WARC-Date", iso_date(r["date"])),
        ("WARC-Target-URI", r["url"]),
        ("WARC-IP-Address", r["ip"] if r["ip"] != "0.0.0.0" else None),
        ("Content-Type", "application/http;msgtype=response" if head else r["mime"]),
        ("WARC-Payload-Digest", f"sha256:{r['digest']}"),
    ]
    if r["to_file"] is None:
        return warc_record("response" if head else "resource", headers, r["block"])
    page = r["to_page"] if r["to_page"] != (1 << 63) - 1 else None
    headers += [
        ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", record_id(f"{r['to_file']} {r['to_offset']}")),
        ("WARC-Refers-To-Target-URI", r["to_url"]),
        ("WARC-Refers-To-Date", iso_date(r["to_date"])),
        ("X-Refers-To-Page", page),
        ("X-Payload-Length", r["size"]),
    ]
    return warc_record("revisit", headers, head)


def read_warc_records(spark, path: str) -> DataFrame:
    """One row per response, resource and revisit record below ``path``.

    Columns: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``record_id``,
    ``date`` and ``payload`` (null for revisits). A stored payload must have the digest its record declares.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    for headers, block in read_warc(batch.column(1)[k].as_py()):
                        kind = headers["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        head, body = split_http(block)
                        declared = headers["warc-payload-digest"].partition(":")[2]
                        if kind != "revisit" and hashlib.sha256(body).hexdigest() != declared:
                            raise ValueError(f"digest of {headers['warc-record-id']} doesn't match its payload")
                        to = headers.get("x-refers-to-page")
                        yield (
                            _page_of(head), headers.get("warc-target-uri"),
                            int(headers["x-payload-length"]) if kind == "revisit" else len(body), declared, kind,
                            int(to) if to is not None else None, headers["warc-record-id"], headers["warc-date"],
                            None if kind == "revisit" else body,
                        )

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "payload"]
        text, number = pa.string(), pa.int64()
        yield from _batched(rows(), names, [number, text, number, text, text, number, text, text, pa.binary()])

    return _files(spark, path).mapInArrow(
        work,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, date string, payload binary",
    )


def pages_to_warc(pages: DataFrame, **columns: str) -> str:
    """Write pages as ARC files, convert them, and return the folder of the WARC files.

    Null html is an empty payload, a null URL becomes a URN of the page's number; a null number and repeated numbers are
    kept. An empty table gives a folder without records. Other columns are ignored.
    """
    spark = pages.sparkSession
    arc_path, warc_path = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc_path, **columns)
    convert(spark, arc_path, warc_path)
    return warc_path


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as its WARC record shows it."""
    path = pages_to_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
