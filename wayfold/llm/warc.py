"""Web archives: legacy ARC records converted to WARC, written by Spark and read back.

A legacy archive opens with a ``filedesc://`` record that declares its version; version 1 headers have five
fields and version 2 headers ten, and the last is the length of what follows. Each record becomes a WARC record
with an identifier, an ISO timestamp, a type and digests made from it, compressed as a gzip member of its own. Archives
are written through Spark's text sink, so they go to any store that Spark writes to and are committed by task; the
sink's line end is the zero byte that ends each member. A file holds about FILE_BYTES and is read record by record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import fresh_path, slices, small_batches, stash

#: Header fields of an archive of either version, as the format has them.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
#: Payloads below this size are always stored.
LEAST_REVISIT = 100
#: Compressed bytes from which a file is full. Bytes of a record that go into one gzip member, whose length then ends in a zero byte.
FILE_BYTES, MEMBER = 32 << 20, (1 << 24) - 1
#: Bytes of payloads that leave a reading task at once.
READ_BYTES = 4 << 20
_END = b"\r\n\r\n"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    extra: dict[str, str] = field(default_factory=dict)


def arc_header(version: int, origin: str, date: str) -> bytes:
    """The record that opens an archive."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 {origin}\n{names[version]}\n".encode()
    tail = " ".join(["200", "-", "-", "0", origin]) + " " if version == 2 else ""
    return f"filedesc://{origin} 0.0.0.0 {date} text/plain {tail}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, r: ArcRecord) -> bytes:
    """One record of a legacy archive. Blanks in the address are escaped, as they part the fields."""
    url = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in r.url.encode()) if not r.url.isascii() or " " in r.url else r.url
    values = {"url": url or "-", "ip": r.ip, "date": r.date, "content_type": r.content_type, "length": str(len(r.body))}
    extra = {"result_code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "-"} | r.extra
    return " ".join((values | extra)[k] for k in FIELDS[version]).encode("latin-1", "replace") + b"\n" + r.body + b"\n"


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of a legacy archive, the opening one first. Raises ValueError where a line or length is wrong."""
    at, version = 0, 0
    while at < len(raw):
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        line = raw[at:end].rstrip(b"\r")
        if not line:  # blank lines between records
            at = end + 1
            continue
        parts = line.decode("latin-1").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no length in the header line at byte {at}")
        length, start = int(parts[-1]), end + 1
        body = raw[start : start + length]
        if len(body) < length:
            raise ValueError(f"the record at byte {at} is cut off")
        if parts[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        if not version or len(parts) != len(FIELDS[version]):
            raise ValueError(f"a header line of {len(parts)} fields in version {version}, at byte {at}")
        values = dict(zip(FIELDS[version], parts, strict=True))
        yield ArcRecord(values.pop("url"), values.pop("ip"), values.pop("date"), values.pop("content_type"), body, {k: v for k, v in values.items() if k != "length"})
        at = start + length


def iso_date(date: str) -> str:
    """YYYYMMDDhhmmss, or its first parts, as an ISO timestamp."""
    full = (date + "00000101000000"[len(date) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers of an HTTP message, with the blank line, and its payload. Without headers all is payload."""
    end = block.find(_END) if block.startswith(b"HTTP/") else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def to_warc(r: ArcRecord, refers_to: str | None = None, more: dict[str, str] | None = None, name: str | None = None) -> bytes:
    """The WARC record that says the same. With ``refers_to``, a revisit of that record, without the payload.

    Without a ``name`` the identifier is made from address, date and payload.
    """
    head, payload = split_http(r.body)
    digest = hashlib.sha256(payload).hexdigest()
    opening = r.url.startswith("filedesc://")
    kind = "warcinfo" if opening else "revisit" if refers_to else "response" if head else "resource"
    block = head if refers_to else r.body
    more = more or {}
    name = name or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join([r.url, r.date, digest]))}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {iso_date(r.date)}",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if opening:
        lines += ["Content-Type: application/warc-fields", f"WARC-Filename: {r.url.removeprefix('filedesc://')}"]
    else:
        lines += [f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}", f"WARC-Payload-Digest: sha256:{digest}"]
        lines.append(f"Content-Type: {'application/http; msgtype=response' if head else r.content_type}")
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"{k}: {v}" for k, v in more.items()]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    at = 0
    while at < len(raw):
        end = raw.find(_END, at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in raw[at:end].decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        start = end + 4
        stop = start + int(headers["content-length"])
        if raw[stop : stop + 4] != _END:
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield headers, raw[start:stop]
        at = stop + 4


def gzipped(record: bytes) -> bytes:
    """A record as a gzip member; a very long one as several. The last byte is zero."""
    out = []
    for i in range(0, max(1, len(record)), MEMBER):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [packer.compress(record[i : i + MEMBER]), packer.flush()]
    return b"".join(out)


def members(content: bytes, step: int = 8192) -> Iterator[bytes]:
    """The gzip members of a file, one unpacked at a time. Raises ValueError if the last one is cut off."""
    raw, at = memoryview(content), 0
    while at < len(raw):
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            part = raw[at : at + step]
            if not len(part):
                raise ValueError("the last member is cut off")
            out.append(unpacker.decompress(part))
            at += len(part)
        at -= len(unpacker.unused_data)
        yield b"".join(out)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a file whose records are gzip members."""
    held = b""
    for member in members(content):
        held += member
        end = held.find(_END)
        size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", held[: end + 2]) if end >= 0 else None
        if size and len(held) >= end + 4 + int(size[1]) + 4:
            yield from parse_warc(held)
            held = b""
    if held:
        raise ValueError("the last record is cut off")


def record_id(page: object) -> str:
    """The identifier of a page's record, which revisits of it name, too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page))}>"


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, payload, refers_to) -> (record, volume), each record without the last byte, which the sink's line end adds."""
    written = 0
    for batch in slices(batches, column=2):
        out, volume = [], []
        for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = (payload or "").encode()
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            version = 1 + (page or 0) % 2 if isinstance(page, int) else 1
            date = f"20200101{(page or 0) % 86400 // 3600:02d}{(page or 0) % 3600 // 60:02d}{(page or 0) % 60:02d}" if isinstance(page, int) else "20200101000000"
            legacy = arc_header(version, "pages.arc", date) + arc_record(version, ArcRecord(url or "-", "0.0.0.0", date, "text/html", http + payload))
            _, found = parse_arc(legacy)
            more = {k: str(v) for k, v in (("X-Page-Id", page), ("X-Refers-To-Page-Id", refers)) if v is not None}
            record = gzipped(to_warc(found, None if refers is None else record_id(refers), more, None if page is None else record_id(page)))
            out.append(record[:-1])
            volume.append(written // FILE_BYTES)
            written += len(record)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(volume, pa.int32())], ["value", "volume"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` to WARC files below ``path``, each record a gzip member.

    Of equal payloads of LEAST_REVISIT bytes or more, the row with the smallest id is the response and the others
    revisit it; rows that share that id are responses, too. Null pages have an empty payload, null addresses are
    ``-``; rows without id are responses.
    """
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = keyed.withColumn("digest", F.sha2("html", 256))
    large = keyed.where(f"octet_length(html) >= {LEAST_REVISIT}").select("id", "digest")
    # written tables on both sides, so that a digest of very many pages can be split in the join
    repeated = stash(large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    revisits = stash(large.join(repeated, "digest").where("id <> first").select("id", "digest", "first").distinct(), "revisits")
    joined = keyed.join(revisits, ["id", "digest"], "left").select("id", "url", "html", "first")
    found = small_batches(joined).mapInArrow(_converted, "value binary, volume int").select(F.col("value").cast("string"), "volume")
    found.write.partitionBy("volume").option("compression", "none").option("lineSep", "\0").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row per response or revisit: id, target, date, payload_bytes, payload_digest, record_type, refers_to, payload.

    Lengths and digests of responses are computed anew; a digest that differs from the header's is an error.
    """

    names = ["id", "target", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3 + [pa.binary()]

    def packed(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in filter(None, batch.column(0).to_pylist()):
                rows, size = [[] for _ in names], 0
                for headers, block in records(content):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    length = len(payload)
                    if headers["warc-type"] == "revisit":
                        length = int(head.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {headers['warc-record-id']} isn't what its digest says")
                    values = headers.get("x-page-id"), headers["warc-target-uri"], headers["warc-date"], length, digest, headers["warc-type"], headers.get("x-refers-to-page-id"), payload
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                    size += len(payload)
                    if size >= READ_BYTES:
                        yield packed(rows)
                        rows, size = [[] for _ in names], 0
                yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return small_batches(files).mapInArrow(parsed, "id string, target string, date string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive ``pages`` and read the archives back: (id, payload_bytes, payload_digest, record_type, refers_to).

    Null pages have an empty payload; null addresses are ``-``; pages without id are responses. Repeated rows, and rows
    that share an id, each have a record of their own. Very long pages go as several gzip members. An empty table gives
    no rows; other columns, whatever their names, are not read.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    back = read_archives(pages.sparkSession, path)
    return back.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
