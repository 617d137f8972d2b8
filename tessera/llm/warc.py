r"""Legacy archive converter: ARC bytes to WARC/1.0 records, and readers and writers for both.

An ARC file starts with a version block whose first line names the version and whose second line names the fields of
the record lines: five in version 1 (URL IP-address Archive-date Content-type Archive-length), ten in version 2, which
adds a result code, checksum, location, offset and filename. The declared length, not the content, ends a record. For
each record the converter makes a WARC record: an identifier from the record's place and content (the same on every
run), WARC-Date from the 14-digit date, a type, and block and payload digests in base32 SHA-1.

Archives are written through Spark's text sink, as header and block are UTF-8 and a WARC record ends with \r\n\r\n,
which is the sink's line separator; so any store that Spark writes to will do. The sink gzips a file as a whole, not
record by record; files are bounded by records and bytes (SIZES), so a reader holds no more than one.

Null html or url: empty payload; `-` for the URL. Repeated rows: each gets its record. Equal payloads of at least
min_dedup bytes: the smallest page id is the response, the others are revisits without a payload. Ties: equal page
ids with equal payloads, all responses. Null page id: a record without a page id, a response always, as no id is the
smallest. Very long payloads: one record a file. Empty table: no archive is written and the result is empty. Clashing columns:
only the id, URL and html columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.graph import join_ids
from tessera.llm.shared import fresh_path, materialise, release

END = "\r\n\r\n"
#: Fields of a record line by version, as the version block states them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: (payloads below so many bytes, records to an archive file at most): about 64 MB to a file, or one record.
SIZES = [(1 << 17, 500), (1 << 20, 64), (1 << 23, 8), (1 << 62, 1)]
#: Repeats that are broadcast to the pages, by id and digest; beyond it both sides are shuffled.
MAX_REPEATS = 100_000


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of ARC bytes: the fields of its line by name, `version`, and `content` of the declared length.

    Raises ValueError where a line has not the fields that its version states, or the content ends early.
    """
    at, version, names = 0, 0, []
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = (data[at:end] if end >= 0 else data[at:]).decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if end < 0 or not line[-1].isdigit():
            raise ValueError(f"no record line at byte {at}")
        content = data[end + 1 : end + 1 + int(line[-1])]
        if len(content) < int(line[-1]):
            raise ValueError(f"record at byte {at} ends after {len(content)} of {line[-1]} bytes")
        at = end + 1 + len(content)
        if line[0].startswith("filedesc:"):
            head = content.decode().split("\n")
            version, names = int(head[0].split(" ")[0]), head[1].split(" ")
            if names != FIELDS.get(version, "").split(" "):
                raise ValueError(f"unknown ARC version {head[0]!r}")
            continue
        if len(line) != len(names):
            raise ValueError(f"{len(line)} fields in a record line of version {version}")
        yield dict(zip(names, line)) | {"version": version, "content": content}


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload)."""
    at = content.find(b"\r\n\r\n")
    return (content[: at + 4], content[at + 4 :]) if content.startswith(b"HTTP/") and at >= 0 else (b"", content)


def warc_date(date: str) -> str:
    """14 (or 12, or 8) digits of an ARC date as ISO 8601 in UTC; what is missing is zero."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def to_warc(record: dict, key: str, refers_to: str | None = None) -> tuple[bytes, bytes]:
    """(header, block) of the WARC record for an ARC record; a revisit if the key of an earlier record is given."""
    head, payload = split_http(record["content"])
    block = head if refers_to is not None else record["content"]
    kind = "revisit" if refers_to is not None else "response" if head else "resource"
    mime = "application/http; msgtype=response" if head else record["Content-type"]
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {warc_date(record['Archive-date'])}",
        f"WARC-Target-URI: {record['URL']}", f"WARC-IP-Address: {record['IP-address']}", f"Content-Type: {mime}", f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + END).encode(), block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records; blocks end by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has not its {n} bytes")
        yield headers, block
        at = end + 8 + n


def http_headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:] if x)}


def arc_of_page(page_id: Column, url: Column, html: Column, version: int = 1, date: str = "20240101000000") -> Column:
    """ARC text of one page: version block and record. The HTTP head carries the page id and the payload's length."""
    size = F.octet_length(html).cast("string")
    url = F.regexp_replace(F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.lit("-")), r"[\x00-\x20\x7F]", "%20")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\nX-Page-Id: "), page_id.cast("string"), F.lit("\r\n\r\n"))
    names = f"{version} 0 tessera\n{FIELDS[version]}\n"
    more = {1: " ", 2: " 200 - - 0 pages.arc "}[version]
    top = f"filedesc://pages.arc 0.0.0.0 {date} text/plain{more}{len(names)}\n{names}\n"
    return F.concat(F.lit(top), url, F.lit(f" 0.0.0.0 {date} text/html{more}"), (F.octet_length(head) + F.octet_length(html)).cast("string"), F.lit("\n"), head, html, F.lit("\n"))


def convert(arcs: DataFrame) -> DataFrame:
    """arcs (arc string, key string, refers_to string) to rows of one WARC record each, as text without its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for arc, key, refers in zip(*(batch.column(c) for c in ("arc", "key", "refers_to"))):
                for i, record in enumerate(read_arc(arc.as_py().encode())):
                    header, block = to_warc(record, key.as_py() + (f"/{i}" if i else ""), refers.as_py())
                    out.append((header + block).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_string()).cast(pa.string())], ["value"])

    return arcs.select("arc", "key", "refers_to").mapInArrow(run, "value string")


def first_of_payload(pages: DataFrame, min_dedup: int) -> DataFrame:
    """(id, digest, first) of pages (id, digest, size) whose payload an earlier id has, at least min_dedup bytes long."""
    keys = pages.where(F.col("size") >= min_dedup).select("id", "digest")
    many = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return keys.join(many, "digest").where("id <> first").select("id", "digest", "first").distinct()


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_dedup: int = 0, version: int = 1) -> None:
    """Write a WARC record for each page under path, converted from its ARC form.

    To find equal payloads digests are shuffled. Pages stay where they are if few of them repeat another.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    sizes = materialise(page.select("id", "digest", "size"), "digests")
    later = materialise(first_of_payload(sizes, min_dedup), "repeats")
    name = lambda c: F.concat(F.lit("page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    arcs = join_ids(page, later, ["id", "digest"], "left", MAX_REPEATS).select(
        "size", arc_of_page(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("url"), F.col("html"), version).alias("arc"), name("id").alias("key"), F.when(F.col("first").isNotNull(), name("first")).alias("refers_to")
    )
    largest, low = sizes.agg(F.max("size")).first()[0] or 0, 0
    for high, records in SIZES:
        if low <= largest:
            rows = arcs.where((F.col("size") >= low) & (F.col("size") < high)) if largest >= SIZES[0][0] else arcs
            convert(rows).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        low = high
    release(sizes, later)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under path: record_id, page_id, record_type, payload_bytes, payload_digest, refers_id, url, date.

    payload_digest is computed from a response's payload and must equal the header's; a revisit has no payload, so its
    digest and length are those that its headers state. page_id is a string, null where a record states none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_id", "url", "date"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for h, block in read_warc(gzip.decompress(content.as_py())):
                    head, payload = split_http(block)
                    http, stated = http_headers(head), h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] != "revisit" and base32_sha1(payload) != stated:
                        raise ValueError(f"{h['warc-record-id']}: its payload has not the digest stated")
                    size = int(http.get("content-length", 0)) if h["warc-type"] == "revisit" else len(payload)
                    rows.append((h["warc-record-id"], http.get("x-page-id") or None, h["warc-type"], size, stated, h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-date"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "record_id string, page_id string, record_type string, payload_bytes long, payload_digest string, refers_id string, url string, date string")


def archive_pages(pages: DataFrame, **how) -> DataFrame:
    """Write pages as WARC under the shared folder, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path, **how)
    kind = pages.schema[how.get("id_col", "page_id")].dataType
    got = materialise(read_archive(spark, path).withColumn("page_id", F.col("page_id").cast(kind)), "warc-read")
    named = got.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).distinct()
    # the responses that revisits name: few ids of many records, matched by shuffled ids
    revisits = got.where("record_type = 'revisit'").join(named, "refers_id", "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return got.where("record_type <> 'revisit'").select(*cols, F.lit(None).cast(kind).alias("refers_to")).unionByName(revisits.select(*cols, "refers_to"))
