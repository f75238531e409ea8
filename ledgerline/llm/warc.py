"""WARC archives: a writer that stores each payload once, and a salvage reader.

Archives are files of gzip members, one record each. When a check fails, the
reader looks for the next member that is valid or, within plain data, the next
version line, goes on from there, and logs the bytes left out as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, scratch_path

#: an archive file is closed once it has this many bytes
SEGMENT = 8 << 20
LEVEL = 3
_RECORD = "urn:ledgerline:page:"
_TYPES = (b"response", b"revisit", b"warcinfo", b"resource", b"metadata", b"request", b"conversion", b"continuation")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP head alone, with the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_RECORD}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_RECORD}{'' if refers_to is None else refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _segments(batches):
    held: list[bytes] = []
    total = 0
    for batch in batches:
        columns = [batch.column(k) for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            page_id, url, html, first, copies = (x.as_py() for x in row)
            payload = (html or "").encode("utf-8", "surrogatepass")
            revisit = copies is not None and page_id != first
            held.append(member(record_bytes(page_id, url, payload, digest_of(payload), first if revisit else None, revisit)))
            total += len(held[-1])
            if total >= SEGMENT:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["segment"])
                held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["segment"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """A folder of archives, one record per row. Of rows with equal payloads of
    least_bytes or more the smallest id is the response, the others revisit it
    (rows that repeat that id are responses too; null ids revisit, unless the
    group has no other). A null page is an empty payload. Written through
    Spark's own writer, so any file system it knows will do; each file ends in
    a zero byte, which gzip readers take as padding."""
    html = F.coalesce(column(pages, html_col).cast("string"), F.lit(""))
    few = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), html.alias("html"))
    few = few.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary"))))
    groups = few.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # a table: small enough to broadcast or not is then known to the planner, and a hot digest may be split
    groups = materialize(groups.where("copies > 1"), "copies")
    marked = few.join(groups, "digest", "left").select("page_id", "url", "html", "first", "copies")
    files = marked.mapInArrow(_segments, "segment binary").select(F.col("segment").cast("string").alias("value"))
    files.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


class Bad(Exception):
    pass


def parse_record(data: bytes, at: int, proven: bool = False) -> tuple[dict, int]:
    """The record at a place of plain data, and where it ends; Bad if a check fails or, for a proven one, there is no digest."""
    if data[at : at + 7] != b"WARC/1.":
        raise Bad("version")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Bad("head")
    head = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        name = name.strip().lower()
        if not colon or b"\r" in line or b"\n" in line or name in head and name != b"warc-concurrent-to":
            raise Bad("head line")
        head[name] = value.strip()
    length = head.get(b"content-length", b"")
    if not length.isdigit() or head.get(b"warc-type") not in _TYPES:
        raise Bad("length or type")
    start = head_end + 4
    end = start + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("end")
    block = data[start:end]
    wanted = head.get(b"warc-block-digest")
    if wanted and wanted != b"sha1:" + digest_of(block).encode():
        raise Bad("block digest")
    if proven and not wanted:
        raise Bad("no digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    kind = head[b"warc-type"].decode()
    stored = head.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    if kind == "response" and stored and stored != digest_of(payload):
        raise Bad("payload digest")

    def page(name: bytes) -> int | None:
        x = head.get(name, b"").decode("ascii", "replace").strip("<>").removeprefix(_RECORD)
        return int(x) if x.lstrip("-").isdigit() else None

    return {
        "page_id": page(b"warc-record-id"),
        "payload_bytes": len(payload) if kind == "response" else int(said) if said.isdigit() else None,
        "payload_digest": stored or (digest_of(payload) if kind == "response" else None),
        "record_type": kind,
        "refers_to": page(b"warc-refers-to"),
        "url": head.get(b"warc-target-uri", b"").decode("ascii", "replace") or None,
    }, end + 4


def _plain(data: bytes, base: int, proven: bool = False) -> Iterator[tuple[str, dict]]:
    """Records of a member at `base`; gaps are given in its unpacked bytes."""
    at = 0
    while at < len(data):
        try:
            record, end = parse_record(data, at, proven)
            yield "record", record | {"at": base}
            at = end
        except Bad as e:
            to = data.find(b"WARC/1.", at + 1)
            to = len(data) if to < 0 else to
            yield "gap", {"at": base, "bytes": to - at, "why": str(e)}
            at = to


def _before_damage(data: bytes, at: int, end: int) -> bytes:
    """What a member at a place holds before its error, which is in the piece at `end`."""
    unpacker = zlib.decompressobj(31)
    pieces = [unpacker.decompress(data[at:end])]
    try:
        for i in range(end, min(len(data), end + 65_536)):
            pieces.append(unpacker.decompress(data[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(pieces)


def salvage(data: bytes) -> Iterator[tuple[str, dict]]:
    """("record", ...) and ("gap", {at, bytes, why}) of an archive, in order;
    plain and compressed records may alternate. Of a member that is cut short or
    damaged the whole records before that are given (where its bytes are damaged,
    those with a digest), and then the gap from its start."""
    at, member_at = 0, -1
    while at < len(data):
        if data[at] == 0 and not data[at:].strip(b"\x00"):
            return  # padding
        if data[at : at + 7] == b"WARC/1.":
            try:
                record, end = parse_record(data, at)
                yield "record", record | {"at": at}
            except Bad as e:
                while member_at <= at and member_at < len(data):  # a member that follows a whole record
                    member_at = data.find(b"\x1f\x8b\x08", at + 1)
                    while member_at >= 0 and data[member_at - 4 : member_at] != b"\r\n\r\n":
                        member_at = data.find(b"\x1f\x8b\x08", member_at + 1)
                    member_at = len(data) if member_at < 0 else member_at
                end = data.find(b"WARC/1.", at + 1)
                end = min(member_at, len(data) if end < 0 else end)
                yield "gap", {"at": at, "bytes": end - at, "why": str(e)}
            at = end
            continue
        why = "no member"
        if data[at : at + 3] == b"\x1f\x8b\x08":
            unpacker = zlib.decompressobj(31)
            try:
                pieces, end = [], at
                while end < len(data) and not unpacker.eof:  # by pieces: what follows the member is copied back
                    pieces.append(unpacker.decompress(data[end : end + 65_536]))
                    end = min(len(data), end + 65_536)
                if unpacker.eof:
                    yield from _plain(b"".join(pieces), at)
                    at = end - len(unpacker.unused_data)
                    continue
                why, held = "cut short", list(_plain(b"".join(pieces), at))
            except zlib.error as e:
                why, held = str(e)[:80], list(_plain(_before_damage(data, at, end), at, True))
            while held and held[-1][0] == "gap":  # part of this one
                held.pop()
            yield from held
        ends = [x for x in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
        to = min(ends, default=len(data))
        yield "gap", {"at": at, "bytes": to - at, "why": why}
        at = to


RECORDS = "kind string, file string, at long, bytes long, why string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches):
    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in RECORDS.split(", ")])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = [{"kind": kind, "file": path.as_py()} | x for kind, x in salvage(content.as_py())]
            for i in range(0, len(rows), 5_000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 5_000], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind `record` and, for each quarantined stretch of bytes, `gap` (file, at, bytes, why)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, RECORDS)


def intact(rows: DataFrame) -> DataFrame:
    """The records of read_archives(); any gap is an error."""
    lost = F.raise_error(F.concat(F.lit("gap in "), F.coalesce("file", F.lit("?")), F.lit(" at "), F.col("at").cast("string"), F.lit(": "), F.coalesce("why", F.lit("?"))))
    return rows.withColumn("page_id", F.when(F.col("kind") == "gap", lost.cast("long")).otherwise(F.col("page_id"))).drop("kind")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives to the shared folder and reads them back: page_id,
    payload_bytes, payload_digest, record_type, refers_to. An empty table has an
    empty archive; repeated rows have a record each; other columns aren't
    carried. What was just written must be whole: a gap fails the query."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    return intact(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
