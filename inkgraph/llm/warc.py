"""Legacy web-archive conversion: ARC 1 and ARC 2 files become WARC 1.1 records.

An ARC file is a version block followed by records. Each record is one header
line, whose fields depend on the version, then as many bytes as the line
declares:

* version 1: ``url ip date mime length``
* version 2: ``url ip date mime status checksum location offset filename length``

`convert` parses those lines and lengths and synthesises what WARC wants and
ARC lacks: record identifiers, ISO timestamps, record types and SHA-1 digests.
`write_warc` and `read_warc` store and load whole archives.

Defined results: a null or empty payload is a record of no bytes; ARC dates
of fewer than 14 digits are padded with the smallest valid date parts; a
malformed header line raises, since a wrong length would corrupt what follows; an
empty input gives no rows. Inputs are selected by name, so extra columns do no
harm. Rows that repeat a key are records of their own, and those of equal payload are treated alike (with the
largest key: all are responses); rows that repeat a key and a payload describe one capture and share its
identifier. A null key counts as the least. A very long payload is one record, held whole by one task at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import shared_dir, table

ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_BYTES = 4 << 20
#: Bytes of records, on average, that go into one WARC file; a reader holds a file at a time, or as many as Spark packs into one partition.
FILE_BYTES = 32 << 20
WARC_SCHEMA = "key long, url string, record_id string, warc_date string, warc_type string, mime string, http string, payload binary, payload_bytes long, payload_digest string, block_digest string"
READ_SCHEMA = "key long, url string, record_id string, warc_type string, payload binary, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(version: int, date: str, name: str = "pages.arc") -> bytes:
    body = f"{version} 0 inkgraph\n{ARC_FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain" + (f" 200 - - 0 {name}" if version == 2 else "") + f" {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, offset: int = 0, name: str = "pages.arc") -> bytes:
    url = url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-"
    extra = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{extra} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Yield (version, header fields, block) for each record; the first is the version block."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes, {len(block)} remain")
        if values[0].startswith("filedesc://"):
            version = int(block.split(b" ", 1)[0])
        names = ARC_FIELDS[version].split(" ")
        if len(values) != len(names):
            raise ValueError(f"ARC version {version} header at byte {at} has {len(values)} fields")
        yield version, dict(zip(names, values, strict=True)), block
        at = end + 1 + length


def iso_date(arc_date: str) -> str:
    digits = arc_date + "00000101000000"[len(arc_date) : 14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def to_warc(fields: dict[str, str], block: bytes) -> dict:
    """The WARC fields equivalent to one ARC record."""
    url = fields["URL"]
    http, payload = b"", block
    if url.startswith("filedesc:"):
        kind = "warcinfo"
    elif url.split(":")[0] in ("http", "https") or block.startswith(b"HTTP/"):
        kind = "response"
        if block.startswith(b"HTTP/") and (cut := block.find(b"\r\n\r\n")) >= 0:
            http, payload = block[: cut + 4], block[cut + 4 :]
    else:
        kind = "resource"
    key = next((int(x[13:]) for x in http.decode("utf-8", "replace").split("\r\n") if x.startswith("X-Record-Key:")), None)
    date, digest = iso_date(fields["Archive-date"]), base32_sha1(payload)
    name = f"{url}\n{date}\n{digest}\n{key}"
    return {"key": key, "url": url, "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", "warc_date": date, "warc_type": kind, "mime": fields["Content-type"], "http": http.decode("utf-8", "replace"), "payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "block_digest": base32_sha1(block)}


def _packed(batches: Iterator[pd.DataFrame], date: str) -> Iterator[bytes]:
    """ARC files of about ``ARC_BYTES``, version 1 and 2 in turn."""
    version, parts, held = 1, [], 0
    for pdf in batches:
        for k, u, b in zip(pdf["key"], pdf["url"], pdf["body"], strict=True):
            b = b or b""
            named = "" if pd.isna(k) else f"X-Record-Key:{int(k)}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(b)}\r\n{named}\r\n"
            if not parts:
                parts, held = [arc_version_block(version, date)], 0
            parts.append(arc_record(version, u or "", "0.0.0.0", date, "text/html", head.encode() + b, held))
            held += len(parts[-1])
            if held >= ARC_BYTES:
                yield b"".join(parts)
                version, parts = 3 - version, []
    if parts:
        yield b"".join(parts)


def _converted(archives: Iterator[bytes | None]) -> Iterator[pd.DataFrame]:
    """WARC fields of the records of each archive, about ``ARC_BYTES`` at a time."""
    for data in archives:
        rows, size = [], 0
        for _, fields, block in parse_arc(data or b""):
            rows.append(to_warc(fields, block))
            size += len(block)
            if size >= ARC_BYTES:
                yield pd.DataFrame(rows).astype({"key": "Int64"})
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows).astype({"key": "Int64"})


def _narrow(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(body).cast("binary").alias("body"))


def pack_arc(pages: DataFrame, key: str, url: str, body: str, date: str = "20240101000000") -> DataFrame:
    """Rows -> ARC files of about ``ARC_BYTES``, version 1 and 2 in turn; ``archive binary``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for archive in _packed(batches, date):
            yield pd.DataFrame({"archive": [archive]})

    return _narrow(pages, key, url, body).mapInPandas(pack, "archive binary")


def convert(archives: DataFrame, column: str = "archive") -> DataFrame:
    """ARC files in ``column`` -> one row of WARC fields per record (version blocks become warcinfo)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _converted(iter(pdf["archive"]))

    return archives.select(F.col(column).alias("archive")).mapInPandas(parse, WARC_SCHEMA)


def through_arc(pages: DataFrame, key: str, url: str, body: str, date: str = "20240101000000") -> DataFrame:
    """`pack_arc` and `convert` in one task, which so holds one archive at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _converted(_packed(batches, date))

    return _narrow(pages, key, url, body).mapInPandas(run, WARC_SCHEMA)


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Among equal payloads of at least ``min_bytes`` the largest key is the response, the others revisit it.

    Only keys and digests are grouped and shuffled; payloads move once, by key and digest, which name a record and
    its copies. A digest shared by a third of all rows stays one partially aggregated row, and the join that
    looks it up is one that adaptive execution can split.
    """
    keyed = records.filter("warc_type = 'response'").select("key", "record_id", "url", "payload_digest", "payload_bytes")
    order = F.struct(F.col("key").isNotNull().alias("some"), "key", "record_id")
    groups = keyed.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max_by(F.struct("key", "record_id", "url"), order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first")
    refers = keyed.join(groups, "payload_digest").filter(F.col("first.key").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("first.key"))))
    refers = refers.groupBy("key", "payload_digest").agg(F.first(F.struct(F.col("first.key").alias("key"), F.col("first.record_id").alias("id"), F.col("first.url").alias("url"))).alias("to"))
    refers = refers.select(F.col("key").alias("own"), F.col("payload_digest").alias("own_digest"), F.col("to.key").alias("refers_to_key"), F.col("to.id").alias("refers_to_id"), F.col("to.url").alias("refers_to_url"))
    joined = records.join(refers, F.col("key").eqNullSafe(F.col("own")) & (F.col("payload_digest") == F.col("own_digest")) & (F.col("warc_type") == "response"), "left").drop("own", "own_digest")
    return joined.withColumn("warc_type", F.when(F.col("refers_to_id").isNotNull(), "revisit").otherwise(F.col("warc_type")))


def write_warc(records: DataFrame, path: str, mean_bytes: float | None = None) -> None:
    """gzip-compressed WARC files of about FILE_BYTES, through Spark's committed text writer.

    A record ends in CR LF CR LF; the writer's line end is the last of those bytes. Spark bounds files by
    records, so their number follows from the mean size of a payload, which is measured where it is not given.
    """
    mean = 1000 + ((records.agg(F.avg("payload_bytes")).first()[0] or 0) if mean_bytes is None else mean_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.when(value.isNotNull(), line(name, value)).otherwise("")
    body = F.when(F.col("warc_type") == "revisit", F.encode("http", "utf-8")).otherwise(F.concat(F.encode("http", "utf-8"), F.coalesce("payload", F.lit(b""))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), F.when(F.col("warc_type") != "revisit", line("WARC-Block-Digest", F.concat(F.lit("sha1:"), "block_digest"))).otherwise(""),
        optional("WARC-X-Record-Key", F.col("key").cast("string")), line("WARC-X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("warc_type") == "revisit", F.concat(line("WARC-Profile", F.lit(IDENTICAL)), line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_id", F.lit(">"))), line("WARC-Refers-To-Target-URI", F.col("refers_to_url")), line("WARC-X-Refers-To-Key", F.col("refers_to_key").cast("string")))).otherwise(""),
        line("Content-Type", F.when(F.col("http") != "", F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))), line("Content-Length", F.length("body").cast("string")), F.lit("\r\n"),
    )
    record = F.concat(F.encode("head", "utf-8"), F.col("body"), F.lit(b"\r\n\r")).cast("string")
    records.withColumn("body", body).withColumn("head", head).select(record.alias("value")).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / mean))).option("lineSep", "\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Yield (header fields, block) by declared lengths from a plain or gzip-compressed archive."""
    unzip = zlib.decompressobj(47) if data[:2] == b"\x1f\x8b" else None
    held, at = b"" if unzip else data, 0

    def more() -> bool:
        nonlocal held, data, unzip, at
        if unzip is None or not data:
            return False
        new = unzip.decompress(data, 1 << 20)
        held, at = held[at:] + new, 0
        data = unzip.unconsumed_tail
        if unzip.eof and unzip.unused_data:
            data, unzip = unzip.unused_data, zlib.decompressobj(47)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("WARC header without an end")
                return
        lines = held[at:end].decode("utf-8").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        at, length = end + 4, int(fields["Content-Length"])
        while len(held) < at + length + 4:
            if not more():
                raise ValueError("WARC record cut short")
        yield fields, held[at : at + length]
        at += length + 4


def read_warc(spark, path: str) -> DataFrame:
    """Whole archives -> one row per record; a file is parsed as a stream."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: None if x is None else int(x)
        for pdf in batches:
            for content in pdf["content"]:
                rows, size = [], 0
                for f, block in parse_warc(content):
                    revisit, cut = f["WARC-Type"] == "revisit", block.find(b"\r\n\r\n") if f["Content-Type"].startswith("application/http") else -4
                    payload = None if revisit else block[cut + 4 :]
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and base32_sha1(payload) != digest:
                        raise ValueError(f"payload of {f['WARC-Record-ID']} does not match its digest")
                    length = int(f["WARC-X-Payload-Length"]) if revisit else len(payload)
                    rows.append({"key": number(f.get("WARC-X-Record-Key")), "url": f["WARC-Target-URI"], "record_id": f["WARC-Record-ID"][1:-1], "warc_type": f["WARC-Type"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "refers_to_id": f["WARC-Refers-To"][1:-1] if revisit else None, "refers_to_key": number(f.get("WARC-X-Refers-To-Key"))})
                    size += len(block)
                    if size >= ARC_BYTES:
                        yield pd.DataFrame(rows).astype({"key": "Int64", "refers_to_key": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows).astype({"key": "Int64", "refers_to_key": "Int64"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInPandas(parse, READ_SCHEMA)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` through ARC files and WARC archives, and back."""
    pages = table(spark, sf_dir, "pages")
    records = mark_revisits(through_arc(pages, "page_id", "url", "html").filter("warc_type != 'warcinfo'"))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(records, path, pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0)
    return read_warc(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_key").alias("refers_to"))


ORACLE_OP7 = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> 15) & 31 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> 10) & 31 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> 5) & 31 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) & 31 AS INT), 1)), '') AS payload_digest
  FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN NULL ELSE max(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
FROM coded
"""
