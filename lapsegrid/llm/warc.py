"""WARC archives: writing, reading and revisit resolution.

Archives are WARC/1.1 files of one gzip member per record, so that a record can be read by
its offset alone. A file is bounded by its bytes and is one row for Spark's text writer, which
brings it to any file system that Spark reaches through its commit protocol; the writer's line
separator is an empty gzip member, the last of each file.

Headers (page, payload digest, length) are shuffled to find the revisits; payloads are not:
responses are written where they are read, revisits need no payload at all.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsegrid.llm.common import bounded_batches, columns, new_path, remove, staged, without

#: Payloads below this many bytes are always stored whole.
REVISIT_LEAST = 1000
#: Compressed bytes of an archive (it ends with the record that reaches this).
FILE_BYTES = 16 << 20
#: Compressed bytes fed to the decompressor at a time, and rows and bytes of a batch read back.
READ_BYTES, READ_ROWS, READ_BATCH = 1 << 16, 1000, 4 << 20
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
#: Target of a page without a URL.
NO_URL = "urn:page:without-url"
CRLF = "\r\n"
#: A gzip member without content.
EMPTY = gzip.compress(b"", mtime=0)
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# -- resolution of headers ------------------------------------------------
def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def _keys() -> list[Column]:
    """Two hashes of a page_id and its payload's digest."""
    return [F.xxhash64("page_id", "digest"), F.xxhash64(F.lit(1), "page_id", "digest")]


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, digest (hex SHA-1) and n_bytes of every page's payload."""
    payload = _payload()
    return pages.select("page_id", "url", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))


def revisits(own: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """The headers that revisit another page, with ``first``, its page_id.

    Headers alone are shuffled, by payload digest: a map-side combined aggregate gives each
    repeated digest its response (the largest page_id), and an equi-join gives it to the others.
    Equal (page_id, payload) rows are one capture: none revisits another. A null page_id never does.
    """
    large = own.where(F.col("n_bytes") >= least)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(first, "digest").where(F.col("page_id") < F.col("first"))


# -- writing --------------------------------------------------------------
def record(named: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member. Line breaks in a value are percent-encoded, so that none can forge a header."""
    lines = [f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in named if v is not None]
    head = CRLF.join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _images(run: str, date: str, part: str, members):
    """Rows -> file images of at most FILE_BYTES and a record. Ids follow from the run, the task and the row."""

    def build(batches) -> Iterator[pa.RecordBatch]:
        task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        image = lambda: pa.record_batch({"image": pa.array([b"".join(held)], pa.binary())})
        for batch in batches:
            for row in batch.to_pylist():
                name = uuid.uuid5(uuid.UUID(run), f"{part}-{task}-{k}")
                k += 1
                held.append(members(row, f"<urn:uuid:{name}>", date))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield image()
                    held, size = [], 0
        if held:
            yield image()

    return build


def _response(row: dict, name: str, date: str) -> bytes:
    named = [
        ("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", NO_URL if row["url"] is None else row["url"]),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("X-Page-ID", None if row["page_id"] is None else str(row["page_id"])),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(named, _HTTP.encode() + (row["html"] or "").encode("utf-8", "surrogatepass"))


def _revisit(row: dict, name: str, date: str) -> bytes:
    named = [
        ("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", NO_URL if row["url"] is None else row["url"]),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("X-Page-ID", str(row["page_id"])), ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", row["to_record"]), ("WARC-Refers-To-Target-URI", NO_URL if row["to_url"] is None else row["to_url"]), ("WARC-Refers-To-Date", row["to_date"]),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(named, _HTTP.encode())


def _write(images: DataFrame, path: str) -> None:
    text = images.select(F.col("image").cast("string"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_LEAST, date: str | None = None) -> None:
    """Write a deduplicated archive set of ``pages`` (page_id, url, html) under ``path``: responses, then
    revisits, which refer to the records, targets and dates that the written responses tell.

    ``date`` is the capture's (UTC, default: now). Every record has an id of its own, repeated rows too.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    run, date = str(uuid.uuid4()), date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = staged(headers(pages), "warc-headers")
    later = staged(revisits(own, least).select("page_id", "url", "digest", "first"), "warc-revisits")
    lost = staged(later.select(*(k.alias(f"d{i}") for i, k in enumerate(_keys()))).distinct(), "warc-keys")
    whole = without(pages.select("page_id", "url", "html", F.sha1(_payload()).alias("digest")), _keys(), lost)
    _write(whole.mapInArrow(_images(run, date, "response", _response), "image binary"), f"{path}/responses")
    to = read_headers(spark, f"{path}/responses").withColumn("first", F.col("page").cast(pages.schema["page_id"].dataType))
    wanted = later.select("first", "digest").distinct()
    one = F.min(F.struct("record_id", "url", "date")).alias("to")
    targets = to.join(wanted, ["first", "digest"]).groupBy("first", "digest").agg(one)
    marked = later.join(targets, ["first", "digest"], "left").select("page_id", "url", "digest", F.col("to.record_id").alias("to_record"), F.col("to.url").alias("to_url"), F.col("to.date").alias("to_date"))
    _write(marked.mapInArrow(_images(run, date, "revisit", _revisit), "image binary"), f"{path}/revisits")
    for frame in (own, later, lost):
        remove(frame)


# -- reading --------------------------------------------------------------
def gzip_members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the members of a gzip file."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, out, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if end >= len(data):
                raise ValueError("truncated archive")
            out.append(unpack.decompress(view[end : end + READ_BYTES]))
            end = min(len(data), end + READ_BYTES)
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (headers by lower-case name, block) of uncompressed WARC bytes."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("truncated WARC header")
        lines = data[at:end].decode("utf-8", "surrogatepass").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4 + int(named["content-length"])
        if len(data) < at + 4:
            raise ValueError("truncated WARC block")
        yield named, data[end + 4 : at]
        at += 4


def payload_of(named: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP header, where it has one."""
    return block.partition(b"\r\n\r\n")[2] if named.get("content-type", "").startswith("application/http") else block


_ROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()),
     ("said", pa.string()), ("refers_to", pa.string()), ("page", pa.string()), ("n_bytes", pa.int64()), ("digest", pa.string())]
)
_HEADERS = "file string, offset long, length long, record_id string, url string, date string, record_type string, said string, refers_to string, page string, n_bytes long, digest string"


def _read(with_payload: bool):
    schema = _ROW.append(pa.field("payload", pa.binary())) if with_payload else _ROW

    def read(batches) -> Iterator[pa.RecordBatch]:
        flush = lambda rows: pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for path, content in columns(batch, "path", "content"):
                rows, size = [], 0
                for offset, length, data in gzip_members(content):
                    for h, block in parse(data):
                        payload = payload_of(h, block)
                        url = h.get("warc-target-uri")
                        row = (path, offset, length, h["warc-record-id"], None if url == NO_URL else url, h["warc-date"], h["warc-type"], h.get("warc-payload-digest", "").rpartition(":")[2])
                        row += (h.get("warc-refers-to"), h.get("x-page-id"), len(payload), hashlib.sha1(payload).hexdigest())
                        rows.append((*row, payload) if with_payload else row)
                        size += len(payload) if with_payload else 0
                        if size > READ_BATCH or len(rows) >= READ_ROWS:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    return read


def _files(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("path", "content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Records under ``path`` without payloads: file, offset and length of the member, record_id, url, date,
    record_type, said (digest as stated), refers_to, page, and n_bytes and digest of the stored payload."""
    return _files(spark, path).mapInArrow(_read(False), _HEADERS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``read_headers`` with the payload."""
    return _files(spark, path).mapInArrow(_read(True), _HEADERS + ", payload binary")


def resolve(stored: DataFrame) -> DataFrame:
    """Resolve revisits of headers read back: page, payload_bytes, payload_digest, record_type, refers_to (a page).

    Digest and length of responses come from the stored block; a revisit takes both from
    the response whose record id it refers to.
    """
    whole = stored.where("record_type = 'response'")
    later = stored.where("record_type = 'revisit'").select("page", F.col("refers_to").alias("to_id"), "said")
    wanted = later.select(F.col("to_id").alias("record_id")).distinct()
    to = whole.join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("to_id"), F.col("page").alias("to_page"), "n_bytes", "digest")
    found = later.join(to, "to_id", "left").withColumn("digest", F.coalesce("digest", "said"))
    return whole.select("page", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to")).unionByName(
        found.select("page", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("to_page").alias("refers_to"))
    )


def round_trip(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """Write ``pages`` as deduplicated archives in the shared folder, read them back and resolve them.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html
    is an empty payload; a null page_id comes back null and is a response; a null url stays null;
    repeated rows stay repeated; payloads of any length are one record; other columns are
    ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    kind = pages.schema["page_id"].dataType
    found = resolve(staged(read_headers(spark, path), "warc-read"))
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, cast(n AS bigint) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN g.top > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top > p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= 1000
"""
