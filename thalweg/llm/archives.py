"""Web archives: legacy ARC files written, read and converted to WARC.

An archive is a row of a table in the shared folder: its name and its bytes.
Those written here are gzip members, one per record, as the formats ask for,
and hold up to ``SEGMENT`` bytes of records, so no task ever holds more. Those
read may have several records in a member, or not be compressed at all. ARC
header lines depend on the version that the file's first record declares;
record bodies are found by their declared lengths, never by looking for marks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import table

SEGMENT = 4 << 20
# The field names of the two versions of ARC header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20240101000000"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:thalweg:archives")


@dataclass
class Record:
    """One archived exchange: where it came from, its HTTP head and its payload."""

    url: str
    date: str
    kind: str
    status: int
    head: bytes
    payload: bytes

    def field(self, name: str) -> str | None:
        found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", self.head)
        return found[1].decode(errors="surrogateescape") if found else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes for the same data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The contents of concatenated gzip members, or the data itself if it isn't compressed. ValueError for a member that is cut short."""
    if data and not data.startswith(b"\x1f\x8b"):
        yield data
        return
    while data:
        reader = zlib.decompressobj(31)
        try:
            yield reader.decompress(data) + reader.flush()
        except zlib.error as broken:
            raise ValueError(f"damaged gzip member: {broken}") from broken
        if not reader.eof:
            raise ValueError("gzip member is cut short")
        data = reader.unused_data


def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def arc_head(name: str, version: int) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 thalweg\n{ARC_FIELDS[version]}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, version: int, name: str, offset: int, block: bytes) -> bytes:
    line = f"{url} 0.0.0.0 {DATE} text/html"
    if version == 2:
        line += f" 200 {digest(block)} - {offset} {name}"
    return f"{line} {len(block)}\n".encode() + block + b"\n"


def safe_url(url: str | None) -> str:
    """A URL without white space, since header lines are split at blanks."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"


def read_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file, by the header fields that its version block names.

    Members are read on from record to record by the declared lengths. Bytes
    of a header line that aren't UTF-8 are kept. Raises ValueError on an
    unknown version, a header line that doesn't match it, or a record shorter
    than it declares.
    """
    names = None
    for block in members(data):
        at = 0
        while True:
            while block[at : at + 1] in (b"\n", b"\r"):  # records are set apart by line ends
                at += 1
            if at >= len(block):
                break
            end = block.find(b"\n", at)
            if end < 0:
                raise ValueError("ARC header line without an end")
            parts = block[at:end].rstrip(b"\r").decode(errors="surrogateescape").split(" ")
            if not parts[-1].isdigit():
                raise ValueError(f"ARC header without a length: {parts[0]!r}")
            length = int(parts[-1])
            body = block[end + 1 : end + 1 + length]
            if len(body) < length:
                raise ValueError(f"ARC record of {len(body)} bytes declares {length}")
            at = end + 1 + length
            if names is None:
                version = int(body.split(b" ", 1)[0])
                if version not in ARC_FIELDS:
                    raise ValueError(f"unknown ARC version {version}")
                names = body.split(b"\n")[1].decode().rstrip("\r").split(" ")
                continue
            if len(parts) != len(names):
                raise ValueError(f"ARC header has {len(parts)} fields, not {len(names)}")
            fields = dict(zip(names, parts, strict=True))
            head, mark, payload = body.partition(b"\r\n\r\n")
            if not mark or not head.startswith(b"HTTP/"):
                head, mark, payload = b"", b"", body
            code = fields.get("Result-code", "")
            status = int(code) if code.isdigit() and int(code) else int((re.match(rb"HTTP/\S+ (\d+)", head) or [0, 200])[1])
            yield Record(fields["URL"], fields["Archive-date"], fields["Content-type"], status, head + mark, payload)


def record_id(archive: str, ordinal: int) -> str:
    """A WARC record identifier that converting again gives again."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}/{ordinal}')}>"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(record: Record, own_id: str, first: dict | None = None) -> bytes:
    """A WARC 1.1 response, or a revisit of ``first`` (``id, url, date, page_id``) that leaves the payload out."""
    block = record.head if first else record.head + record.payload
    head = {
        "WARC-Type": "revisit" if first else "response", "WARC-Record-ID": own_id, "WARC-Date": warc_date(record.date),
        "WARC-Target-URI": record.url, "WARC-Payload-Digest": f"sha1:{digest(record.payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if first:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": first["id"],
            "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": warc_date(first["date"]), "X-Refers-To-Page": str(first["page_id"]),
        }
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode(errors="surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, read on by declared lengths within members and in uncompressed files.

    A record shorter than it declares, one whose block doesn't have its
    digest (where it names one), or anything else between records is a
    ValueError.
    """
    for block in members(data):
        at = 0
        while True:
            while block[at : at + 1] in (b"\n", b"\r"):  # records are set apart by line ends
                at += 1
            if at >= len(block):
                break
            end = block.find(b"\r\n\r\n", at)
            first, *lines = block[at : max(end, at)].decode(errors="surrogateescape").split("\r\n")
            if end < 0 or not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = dict(x.split(": ", 1) for x in lines)
            length, at = int(fields["Content-Length"]), end + 4
            body = block[at : at + length]
            if len(body) != length or fields.get("WARC-Block-Digest", f"sha1:{digest(body)}") != f"sha1:{digest(body)}":
                raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
            at += length
            yield fields, body


def write_arcs(pages: DataFrame) -> DataFrame:
    """ARC archives ``(archive, content)`` of ``pages(page_id, url, html)``, both versions in turn."""
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for rows in batches:
            for page_id, url, html in zip(rows["page_id"], rows["url"], rows["html"], strict=True):
                version = 1 + (task + made) % 2
                name = f"{task:06d}-{made:06d}.arc.gz"
                if not parts:
                    parts.append(member(arc_head(name, version)))
                block = http_block(None if page_id is None else int(page_id), (html or "").encode("utf-8", "replace"))
                offset = sum(map(len, parts)) if version == 2 else 0
                parts.append(member(arc_record(safe_url(url), version, name, offset, block)))
                size += len(block)
                if size >= SEGMENT:
                    yield pd.DataFrame({"archive": [name], "content": [b"".join(parts)]})
                    made, parts, size = made + 1, [], 0
        if parts:
            yield pd.DataFrame({"archive": [f"{task:06d}-{made:06d}.arc.gz"], "content": [b"".join(parts)]})

    # Ids travel as text: a null among them would turn a batch of numbers into floats.
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(written, "archive string, content binary")


def index_arcs(arcs: DataFrame) -> DataFrame:
    """``(archive, ordinal, page_id, id, url, date, digest, size)`` of the records of ARC archives."""
    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for archive, content in zip(rows["archive"], rows["content"], strict=True):
                out = [
                    (archive, i, int(r.field("X-Page-Id")) if r.field("X-Page-Id") else None, record_id(archive, i), r.url.encode(errors="surrogateescape").decode(errors="replace"), r.date, digest(r.payload), len(r.payload))
                    for i, r in enumerate(read_arc(content))
                ]
                yield pd.DataFrame(out, columns=["archive", "ordinal", "page_id", "id", "url", "date", "digest", "size"], dtype=object)

    return arcs.mapInPandas(indexed, "archive string, ordinal int, page_id long, id string, url string, date string, digest string, size long")


def convert(arcs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """WARC archives ``(archive, content)`` of ARC ones.

    Of records with equal payloads of ``least_bytes`` or more, those with the
    smallest page id stay responses and the others become revisits of it. The
    first of each digest is a combinable minimum; only a digest's rows that
    come later travel on, as a list per archive, to the archive's bytes.
    """
    index = table(index_arcs(arcs), "arc-index")
    firsts = table(
        index.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest").agg(F.min(F.struct("page_id", "id", "url", "date")).alias("first")),
        "arc-firsts",
    )
    later = (
        index.where(F.col("size") >= least_bytes).join(firsts, "digest").where(F.coalesce(F.col("page_id") != F.col("first.page_id"), F.lit(True)))
        .groupBy("archive").agg(F.collect_list(F.struct("ordinal", "first")).alias("later"))
    )

    def converted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for archive, content, later in zip(rows["archive"], rows["content"], rows["later"], strict=True):
                firsts = {x["ordinal"]: x["first"] for x in (later if later is not None else [])}
                made = [member(warc_record(r, record_id(archive, i), firsts.get(i))) for i, r in enumerate(read_arc(content))]
                yield pd.DataFrame({"archive": [archive.replace(".arc", ".warc")], "content": [b"".join(made)]})

    return arcs.join(later, "archive", "left").select("archive", "content", "later").mapInPandas(converted, "archive string, content binary")


def read_back(warcs: DataFrame) -> DataFrame:
    """A row per WARC record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for content in rows["content"]:
                out = []
                for fields, block in read_warc(content):
                    head, mark, payload = block.partition(b"\r\n\r\n")
                    record = Record(fields["WARC-Target-URI"], "", "", 0, head + mark, payload)
                    revisit = fields["WARC-Type"] == "revisit"
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and said != digest(payload):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    page = record.field("X-Page-Id")
                    size = int(record.field("Content-Length")) if revisit else len(payload)
                    out.append((int(page) if page else None, size, said, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)

    return warcs.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` through ARC archives, WARC archives and back; a row per page.

    A null ``html`` is an empty payload, a null ``url`` reads ``unknown:``, a
    null ``page_id`` comes back null (its record is never the one others
    refer to). Repeated rows each have a record; those with the smallest id
    of their payload are all responses. An empty table gives no archive.
    """
    arcs = table(write_arcs(pages), "arcs")
    return read_back(table(convert(arcs), "warcs"))


#: The same result in DuckDB SQL: of equal payloads the smallest page is the response, and a digest is base32 of 20 bits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (k // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
