"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

The writer puts one record per page into gzip members, one member per record. Of pages with equal payload
that with the largest page_id is the response; the others are revisit records, whose block keeps the HTTP
headers (with the full payload's length) and whose WARC headers name the response.

The reader checks every record (gzip member, version line, content length, trailing blank lines, digests).
After a failed check it looks for the next valid gzip member or version line, goes on from there, and logs
the bytes it passed over with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import cut_lineage, scratch_path, table
from wardline.llm.files import new_file, open_fs

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 27
LEVEL = 1
READ = 1 << 18
#: Bytes of a record in which the end of its head is looked for first; the window then grows.
HEAD = 1 << 16
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    name = "null" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[6:6] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), body


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Bad(Exception):
    pass


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without colon")
        found[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return found


class Source:
    """Bytes of a file by position; holds one window."""

    def __init__(self, uri: str):
        where, path = open_fs(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()
        self.start, self.held = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        if not (self.start <= offset and offset + n <= self.start + len(self.held)):
            self.start, self.held = offset, self.file.read_at(min(max(n, 4 * READ), self.size - offset), offset)
        return self.held[offset - self.start : offset - self.start + n]


def _parse(data, start: int, size: int, fetch) -> tuple[dict[str, str], int, int]:
    """Headers of the record at ``start`` and where its block begins and ends; ``fetch(offset, n)`` gives bytes."""
    window = HEAD
    head = fetch(start, window)
    if not _VERSION_LINE.match(head):
        raise Bad("no version line")
    end = head.find(b"\r\n\r\n")
    while end < 0:
        if len(head) < window:
            raise Bad("headers do not end")
        seen, window = len(head), 4 * window
        head = fetch(start, window)
        end = head.find(b"\r\n\r\n", seen - 3)
    headers = _fields(head[:end].split(b"\r\n")[1:])
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Bad("no content length")
    begin = start + end + 4
    stop = begin + int(length)
    if stop + 4 > size:
        raise Bad("content length beyond the end")
    if fetch(stop, 4) != b"\r\n\r\n":
        raise Bad("no blank lines after the block")
    return headers, begin, stop


def _verified(headers: dict[str, str], block: bytes, offset: int, length: int) -> Record:
    found = Record(offset, length, headers, block)
    given = headers.get("warc-block-digest", "")
    if given.startswith("sha1:") and given[5:] != digest(block):
        raise Bad("block digest differs")
    given = headers.get("warc-payload-digest", "")
    if given.startswith("sha1:") and headers.get("warc-type") == "response" and headers.get("content-type", "").startswith("application/http"):
        if given[5:] != digest(found.http()[1]):
            raise Bad("payload digest differs")
    return found


def _gzip_record(source: Source, offset: int) -> Record:
    unpack, parts, at = zlib.decompressobj(31), [], offset
    try:
        while not unpack.eof:
            data = source.at(at, READ)
            if not data:
                raise Bad("gzip member is cut off")
            parts.append(unpack.decompress(data))
            at += len(data)
    except zlib.error as e:
        raise Bad(f"gzip: {e}") from None
    whole = b"".join(parts)
    headers, begin, stop = _parse(whole, 0, len(whole), lambda o, n: whole[o : o + n])
    if stop + 4 != len(whole):
        raise Bad("bytes after the record in its member")
    return _verified(headers, whole[begin:stop], offset, at - len(unpack.unused_data) - offset)


def _plain_record(source: Source, offset: int) -> Record:
    headers, begin, stop = _parse(None, offset, source.size, source.at)
    return _verified(headers, source.at(begin, stop - begin), offset, stop + 4 - offset)


def _next_start(source: Source, offset: int) -> int:
    """The next place that could begin a gzip member or, at a line start, a record."""
    while offset < source.size:
        data = source.at(offset, 4 * READ)
        places = [p for p in (data.find(GZIP), data.find(b"WARC/")) if p >= 0]
        if places:
            return offset + min(places)
        if len(data) < 8:
            break
        offset += len(data) - 7
    return source.size


def salvage(uri: str) -> Iterator[Record | Gap]:
    """Records and gaps of an archive in file order; together they cover every byte."""
    source = Source(uri)
    offset, lost, reason = 0, None, ""
    while offset < source.size:
        try:
            found = _gzip_record(source, offset) if source.at(offset, 3) == GZIP else _plain_record(source, offset)
        except Bad as e:
            if lost is None:
                lost, reason = offset, str(e)
            offset = _next_start(source, offset + 1)
            continue
        if lost is not None:
            yield Gap(lost, offset - lost, reason)
            lost = None
        yield found
        offset += found.length
    if lost is not None:
        yield Gap(lost, source.size - lost, reason)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html) below ``folder``; returns the manifest (path, n_records), kept in the shared folder.

    Payload is the html in UTF-8, null being empty. Payloads of fewer than ``least_bytes`` are always responses.
    Rows that repeat page_id and payload are records of one kind: all responses if theirs is the largest id.
    A null page_id is a response only where no page of equal payload has an id.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(body)).alias("sha"), F.octet_length(body).alias("size"))
    heads = rows.groupBy("sha").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND head IS NOT NULL")
    ids = rows.select("page_id", "sha", "size").join(heads.select("sha", "head"), "sha").filter(
        (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("head")))
    # Only revisits are joined back; pages travel once, dealt by id and payload.
    revisits = ids.select("page_id", "sha", "head").distinct()
    kind = rows.alias("r").join(
        revisits.alias("v"), F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.sha") == F.col("v.sha")), "left"
    ).select("r.page_id", "r.url", "r.html", "v.head", F.col("v.sha").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, path, n, size = TaskContext.get().partitionId(), None, "", 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([n], pa.int64())], ["path", "n_records"])

        for batch in batches:
            html = batch["html"].cast(pa.large_binary())
            for k, (page_id, url, head, revisit) in enumerate(zip(*(batch[c].to_pylist() for c in ("page_id", "url", "head", "revisit")))):
                payload = html[k].as_py() or b""
                if out is None:
                    path = new_file(folder, f"part-{part:06d}", ".warc.gz")
                    where, at = open_fs(path)
                    out, n, size = where.open_output_stream(at, compression=None), 0, 0
                data = member(record(page_id, url, payload, digest(payload), head, revisit))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    yield row()
                    out = None
        if out is not None:
            out.close()
            yield row()

    return cut_lineage(kind.mapInArrow(run, "path string, n_records bigint"))


def _page(name: str | None) -> int | None:
    """The page id in a record name; null for names this writer does not give."""
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", name or "")
    return int(found[1]) if found else None


def read(paths: DataFrame) -> DataFrame:
    """What the archives in column ``path`` hold, in file order: records and, with ``gap_reason`` set, byte gaps.

    Columns: path, offset, length, page_id, payload_bytes, payload_digest, record_type, refers_to, gap_reason.
    """
    names = ["path", "offset", "length", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "gap_reason"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def row(path: str, found: Record | Gap) -> tuple:
        if isinstance(found, Gap):
            return path, found.offset, found.length, None, None, None, None, None, found.reason
        h = found.headers
        revisit, size = h.get("warc-type") == "revisit", len(found.block)
        if h.get("content-type", "").startswith("application/http"):
            http, body = found.http()
            size = int(http["content-length"]) if revisit and http.get("content-length", "").isdigit() else len(body)
        return (path, found.offset, found.length, _page(h.get("warc-record-id")), size, h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                h.get("warc-type"), _page(h.get("warc-refers-to")) if revisit else None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows = []
                for found in salvage(path):
                    rows.append(row(path, found))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    spread = paths.select("path").repartition(paths.sparkSession.sparkContext.defaultParallelism * 4, "path")
    schema = ("path string, offset bigint, length bigint, page_id bigint, payload_bytes bigint, payload_digest string, "
              "record_type string, refers_to bigint, gap_reason string")
    return spread.mapInArrow(run, schema)


def complete(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``found``, what ``read`` gives for the manifest's archives; the query fails if it has a gap or an archive has not its number of records."""
    held = found.groupBy("path").agg(
        F.count_if(F.col("gap_reason").isNull()).alias("held"), F.count(F.col("gap_reason")).alias("gaps"), F.first("gap_reason", True).alias("reason"))
    wrong = manifest.join(held, "path", "left").filter(
        (F.coalesce("held", F.lit(0)) != F.col("n_records")) | (F.coalesce("gaps", F.lit(0)) > 0))
    bad = wrong.select("path", "n_records", "held", "gaps", "reason").limit(5).collect()
    if bad:
        raise RuntimeError(f"archives do not hold what was written: {bad}")
    return found


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    found = complete(cut_lineage(read(manifest)), manifest)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
