"""WARC archives: writing, reading, and deduplication by revisit records (operator 1).

Archives are written by Spark's text writer: a record's header and block are one value, and the record end (two empty
lines) is the line separator, so every file system that Spark writes to will do. Files are gzipped and hold a bounded
number of records and bytes. They are read back as binary files and walked by Content-Length, record by record.

Revisit resolution shuffles headers: records are grouped by payload digest and length, the one with the largest
page id stays the response, and every other record is joined to it. Decisions and files then meet by the file's path,
for which each (gzipped) file moves once, as a whole, and it is rewritten with fresh headers.

Archives of others may be read too: names of headers are matched whatever their case, digests of responses are worked
out and not read, records of other types (such as ``warcinfo`` and ``request``) stay as they are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, freeze

RECORD_END = "\r\n\r\n"
#: Records, and bytes of records before they are gzipped, in one archive file at most; a larger record has its own file.
FILE_RECORDS, FILE_BYTES = 2_000, 256 << 20
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Base32 digits in the order of their values, and the digits conv() writes for the same values.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

_HEAD = (
    "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, "
    "refers_to_record string"
)


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 40 hex digits are 8 times 5, which is 8 times 4 base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _record(kind: Column, record_id: Column, page_id: Column, url: Column, digest: Column, size: Column, block: Column) -> Column:
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id,
        F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), page_id.cast("string")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, F.lit("\r\nX-Payload-Length: "), size.cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block)


def _save(values: DataFrame, path: str, longest: int) -> None:
    """Write records of at most ``longest`` bytes to files of bounded size."""
    most = max(1, min(FILE_RECORDS, FILE_BYTES // max(1, longest)))
    values.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def write_archives(pages: DataFrame, path: str) -> None:
    """One response record for each row of ``pages(page_id, url, html)``; a null html is an empty payload.

    Record ids number the rows of the scan, so rows that repeat a page_id get records of their own.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    number = F.concat(F.lit("<urn:cueloom:crawl:"), F.monotonically_increasing_id().cast("string"), F.lit(">"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), number.alias("id"),
    )
    raw = F.col("payload").cast("binary")
    value = _record(
        F.lit("response"), F.col("id"), F.col("page_id"), F.col("url"), payload_digest(raw), F.octet_length(raw),
        F.concat(F.lit(HTTP), F.col("payload")),
    )
    longest = rows.agg(F.max(F.octet_length("payload"))).first()[0] or 0
    _save(rows.select(value.alias("value")), path, longest)


class Head(dict):
    """Headers of a record; names are found whatever their case."""

    def __init__(self, lines: list[bytes]):
        super().__init__()
        for line in lines:
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                self[name.strip()] = value.strip()

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(name.lower(), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def walk(content: bytes) -> Iterator[tuple[Head, bytes]]:
    """Headers and block of every record of a gzipped archive, one at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            lines = []
            while (line := f.readline()).strip():
                lines.append(line)
            head = Head(lines)
            block = f.read(int(head.get("Content-Length", "0")))
            f.read(len(RECORD_END))
            yield head, block


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of all records; of responses the digest and the length are those of the payload as read.

    What a record does not have is null, also its id; records of other types have no digest.
    """
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            for head, block in walk(content.as_py()):
                kind, digest, size = head.get("WARC-Type"), None, None
                if kind == "response":
                    body = _payload(block)
                    digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
                elif kind == "revisit":
                    digest, size = head.get("WARC-Payload-Digest"), _number(head.get("X-Payload-Length"))
                    digest = digest and digest.removeprefix("sha1:")
                rows.append((
                    path, head.get("WARC-Record-ID"), kind, _number(head.get("X-Page-Id")), head.get("WARC-Target-URI"),
                    digest, size, head.get("WARC-Refers-To"),
                ))
        names = ["path", "record_id", "record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to_record"]
        kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.int64(), pa.string()]
        cells = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds)], names)


def _files(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    # One file of bounded size is a row; a task may get one file at a time.
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """One row for each record of the gzipped archives under ``path`` whose names fit the pattern."""
    return _files(spark, path, pattern).mapInArrow(_heads, f"path string, {_HEAD}")


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(path, record_id, original)`` of every response that revisits another with an equal payload.

    Of responses with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id (nulls smallest,
    ties by record_id) is the original; smaller payloads stay responses.
    """
    big = heads.filter((F.col("record_type") == "response") & F.col("record_id").isNotNull() & (F.col("payload_bytes") >= min_bytes))
    same = ["payload_digest", "payload_bytes"]
    first = big.groupBy(*same).agg(
        F.max(F.struct("page_id", "record_id", "url")).alias("top"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select(*same, F.col("top.record_id").alias("original"), F.col("top.url").alias("original_url"))
    return big.join(first, same).filter(F.col("record_id") != F.col("original")).select(
        "path", "record_id", "original", "original_url"
    )


#: Headers a response keeps, and names as the format writes them.
KEPT = ("WARC-Date", "WARC-Target-URI", "X-Page-Id", "WARC-Payload-Digest", "X-Payload-Length", "Content-Type")
NAMES = {n.lower(): n for n in (*KEPT, "WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Profile")}


def _fresh(record_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id)}>"


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a file with fresh headers; responses with a decision become revisits without payload.

    Records of other types keep their headers.
    """
    for batch in batches:
        for content, revisits in zip(batch.column(0), batch.column(1)):
            to = {r["record_id"]: r for r in revisits.as_py() or []}
            out, size = [], 0
            for head, block in walk(content.as_py()):
                own = head.get("WARC-Record-ID")
                r = to.get(own)
                if head.get("WARC-Type") == "response" and own is not None:
                    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if r else 'response'}", f"WARC-Record-ID: {_fresh(own)}"]
                    kept = [f"{k}: {head[k]}" for k in KEPT if k in head]
                else:
                    lines, kept = ["WARC/1.1"], [f"{NAMES.get(k, k)}: {v}" for k, v in head.items() if k != "content-length"]
                if r:
                    block = block[: len(block) - len(_payload(block))]
                    lines += [f"WARC-Refers-To: {_fresh(r['original'])}", f"WARC-Profile: {PROFILE}"]
                    if r["original_url"]:
                        lines.append(f"WARC-Refers-To-Target-URI: {r['original_url']}")
                lines += [*kept, f"Content-Length: {len(block)}", "", ""]
                out.append("\r\n".join(lines).encode() + block)
                size += len(out[-1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def rewrite(spark: SparkSession, path: str, revisits: DataFrame, out: str, longest: int, pattern: str = "part-*") -> None:
    """Write the archives under ``path`` to ``out``, each decided record as a revisit.

    ``longest`` are the bytes of the longest payload; records get no longer but for headers.
    """
    by_file = revisits.groupBy("path").agg(
        F.collect_list(F.struct("record_id", "original", "original_url")).alias("revisits")
    )
    records = _files(spark, path, pattern).join(by_file, "path", "left").select("content", "revisits").mapInArrow(
        _rewrite, "value binary"
    )
    _save(records.select(F.col("value").cast("string").alias("value")), out, longest)


def deduplicate(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write archives of ``pages``, deduplicate them, and describe the records of the new archives.

    Returns ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id)``; ``refers_to`` is the
    page_id of the response that a revisit names, found by joining the records. Archives lie in ``folder`` (default: a
    fresh one in the shared folder), ``crawl`` before and ``dedup`` after. Null html is an empty payload, null page_id
    and url stay null, an empty table gives no rows.
    """
    spark = pages.sparkSession
    base = folder or fresh_dir(spark, "warc")
    write_archives(pages, f"{base}/crawl")
    heads = freeze(read_headers(spark, f"{base}/crawl"))
    longest = heads.agg(F.max("payload_bytes")).first()[0] or 0
    rewrite(spark, f"{base}/crawl", resolve(heads, min_bytes), f"{base}/dedup", longest)
    new = read_headers(spark, f"{base}/dedup")
    responses = new.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")
    )
    return new.join(responses, "refers_to_record", "left").select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"
    )
