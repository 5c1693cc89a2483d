"""WARC archives: writing, and a salvage reader.

write_archives(): each page is one gzip member that holds one WARC/1.1 record whose block is an HTTP response with
the html, in UTF-8, as payload (null: empty). Of pages with equal payloads of at least LEAST bytes the one with the
smallest page_id is a `response`; the others are `revisit` records that refer to it and hold no payload, only
its length and digest. Smaller payloads are all responses. A repeated row of the response's own page_id is a response
too; a null page_id never is one if the group has an id. Spark's text writer commits the files, so a lost executor's
attempt leaves nothing behind; between records it puts an empty gzip member, which readers of concatenated members
pass over.

salvage(): reads records one by one, plain or compressed. Each must inflate with a right checksum, begin with a version
line, have a length that ends at a blank line, and match its block digest and, where it holds its payload, its payload digest. After a failed check the reader searches for the
next gzip member or version line from which a record passes them all, goes on from there, and logs the bytes in
between as a quarantined gap with the reason. Inside a member it goes on at the next version line in the inflated bytes;
a member that is cut off or damaged keeps its records before that (if damaged, those with digests). Nothing else is skipped.

read_archives() reads whole files as Spark's binary source gives them; an archive holds RECORDS records at most as
written here, and one is held by a task at a time. A revisit's length and digest are what its header claims until
unresolved() finds the response that it refers to, with that digest and length. op4_warc fails if a gap or an unresolved
revisit is left: a page can't get lost unseen. An empty table gives no records; repeated page_ids are records of their own.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm.common import checkpointed, map_batches, read_table, scratch_folder

LEAST, RECORDS = 100, 5000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    """A gzip member without a time, so that reruns write the same bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = _member(b"")


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# -- the salvage reader -----------------------------------------------------------------------------


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Unsound(ValueError):
    """A check failed. kept: what a broken gzip member held before; resume: where its bytes end."""

    def __init__(self, reason: str, kept: Sequence[Record | Gap] = (), resume: int = 0):
        super().__init__(reason)
        self.kept, self.resume = kept, resume


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
HEADER = re.compile(rb"([^\x00-\x20:]+):[ \t]*([^\r\n]*)\r\n")


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at `at`: headers, block and where it ends."""
    m = VERSION.match(data, at)
    if not m:
        raise Unsound("no version line")
    headers, pos = {}, m.end()
    while m := HEADER.match(data, pos):
        headers[m[1].decode("latin-1").lower()] = m[2].decode("utf-8", "replace")
        pos = m.end()
    if data[pos : pos + 2] != b"\r\n":
        raise Unsound("header without end")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Unsound("no length")
    begin, end = pos + 2, pos + 2 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Unsound("length does not end at the record's end")
    block = data[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:].lower():
        raise Unsound("block digest differs")
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha256:") and headers.get("warc-type") != "revisit" and hashlib.sha256(_payload(headers, block)).hexdigest() != digest[7:].lower():
        raise Unsound("payload digest differs")
    return headers, block, end + 4


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """A record's payload: an HTTP message's body, any other block whole."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def _inflate(data: bytes, at: int, most: float = float("inf")) -> tuple[bytes, int, str]:
    """What the gzip member at `at` holds, `most` bytes of it or a little more, where that ends, and why not all of it came out."""
    unpacker, parts, size, pos, step = zlib.decompressobj(31), [], 0, at, 1 << 16
    while not unpacker.eof and pos < len(data) and size < most:
        before = unpacker.copy()
        try:
            part = unpacker.decompress(data[pos : pos + step])
        except zlib.error as e:
            if step == 1:
                return b"".join(parts), pos, f"gzip: {e}"
            unpacker, step = before, step // 16
            continue
        if size + len(part) >= most and step > 1:
            unpacker, step = before, step // 16
            continue
        parts.append(part)
        size, pos = size + len(part), min(pos + step, len(data))
    return b"".join(parts), pos - len(unpacker.unused_data), "" if unpacker.eof else "gzip member is cut off"


def _inside(inside: bytes) -> list[tuple[int, int, tuple[dict[str, str], bytes] | str]]:
    """(begin, end, record or reason): the sound records of a member's bytes, and the spans between them."""
    out, pos = [], 0
    while pos < len(inside):
        try:
            headers, block, end = _parse(inside, pos)
        except Unsound as e:
            begin, reason, pos = pos, str(e), len(inside)
            for m in VERSION.finditer(inside, begin + 1):
                with contextlib.suppress(Unsound):
                    _parse(inside, m.start())
                    pos = m.start()
                    break
            out.append((begin, pos, reason))
            continue
        out.append((pos, end, (headers, block)))
        pos = end
    return out


def _located(spans: list, at: int, length: int) -> list[Record | Gap]:
    return [Gap(at, length, f"{x}; inflated bytes {a} to {b}") if isinstance(x, str) else Record(at, length, *x) for a, b, x in spans]


def _read_at(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """What the gzip member, or the plain record, at `at` holds, one sound record at least unless it is empty, and where it ends."""
    if data[at : at + 2] != b"\x1f\x8b":
        headers, block, end = _parse(data, at)
        return [Record(at, end - at, headers, block)], end
    inside, end, reason = _inflate(data, at)
    spans = _inside(inside)
    if reason:
        # No checksum vouches for these bytes. Where they are damaged, a record's own digest must.
        sure = [not isinstance(x, str) and (end == len(data) or x[0].get("warc-block-digest", "").startswith("sha256:")) for _, _, x in spans]
        spans = [x if ok or isinstance(x[2], str) else (*x[:2], reason) for x, ok in zip(spans, sure, strict=True)]
        while spans and isinstance(spans[-1][2], str):
            spans.pop()
        if not spans:
            raise Unsound(reason)
        resume = _inflate(data, at, spans[-1][1])[1]
        raise Unsound(reason, _located(spans, at, resume - at), resume)
    if spans and all(isinstance(x, str) for _, _, x in spans):
        raise Unsound(spans[0][2])
    return _located(spans, at, end - at), end


START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All sound records of an archive in order, and the gaps between them."""
    at = 0
    while at < len(data):
        try:
            found, end = _read_at(data, at)
        except Unsound as e:
            yield from e.kept
            begin, reason, found, end = max(at, e.resume), str(e), [], len(data)
            for m in START.finditer(data, max(begin, at + 1)):
                try:
                    found, end = _read_at(data, m.start())
                except Unsound as other:
                    if not other.kept:
                        continue
                    found, end = [], m.start()  # read again as the next
                if found or end == m.start() or m.start() + len(EMPTY_MEMBER) == end:
                    if m.start() > begin:
                        yield Gap(begin, m.start() - begin, reason)
                    break
            else:
                if begin < len(data):
                    yield Gap(begin, len(data) - begin, reason)
                return
        yield from found
        at = end


PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _row(r: Record) -> tuple:
    """type, page_id, url, payload_bytes, payload_digest, refers_to of a record as it was read."""
    kind = r.headers.get("warc-type", "")
    page, other = (PAGE.fullmatch(r.headers.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    if kind == "revisit":
        m = re.search(rb"(?im)^content-length:\s*(\d+)", r.block.partition(b"\r\n\r\n")[0])
        size, digest = int(m[1]) if m else None, r.headers.get("warc-payload-digest", "").removeprefix("sha256:").lower()
    else:
        body = _payload(r.headers, r.block)
        size, digest = len(body), hashlib.sha256(body).hexdigest()
    return kind, int(page[1]) if page else None, r.headers.get("warc-target-uri"), size, digest, int(other[1]) if other else None


READ = "archive string, offset long, length long, quarantined string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """READ's columns: a row for each record and each quarantined gap (its reason, all else null)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for x in salvage(content.as_py()):
                    rows.append((name.as_py(), x.offset, x.length, *((x.reason, *[None] * 6) if isinstance(x, Gap) else (None, *_row(x)))))
            fields = [f.split() for f in READ.split(", ")]
            cols = zip(*rows, strict=True) if rows else [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(cols, fields, strict=True)], [n for n, _ in fields])

        return step

    return map_batches(spark.read.format("binaryFile").load(path).select("path", "content"), make, READ)


def write_archives(pages: DataFrame, path: str, records: int = RECORDS) -> None:
    """Write rows (page_id, url, html) to archives in the new folder `path`."""
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("size"))
    firsts = rows.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    told = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    # A revisit's payload stays behind.
    told = told.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(batch.column(i) for i in range(6)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([_member(record(p.as_py(), u.as_py(), x.as_py() or b"", d.as_py(), n.as_py(), r.as_py())) for p, u, x, d, n, r in rows], pa.binary())], ["member"])

        return step

    # A string column carries the bytes as they are; the separator ends each record with an empty member.
    members = map_batches(told, make, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records).text(path)


def unresolved(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes) that revisits claim and no response among read_archives()'s rows has."""
    key = ["refers_to", "payload_digest", "payload_bytes"]
    # What many revisits refer to is one row before it is looked for.
    asked = records.filter("record_type = 'revisit'").select(*key).distinct()
    there = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *key[1:])
    return asked.join(there, key, "left_anti")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "warc") + "/archives"
    write_archives(read_table(spark, sf_dir, "pages"), path)
    read = checkpointed(read_archives(spark, path))
    if lost := read.filter("quarantined is not null").head(1):
        raise ValueError(f"{lost[0]['archive']}: {lost[0]['length']} bytes at {lost[0]['offset']} were quarantined: {lost[0]['quarantined']}")
    if lost := unresolved(read).head(1):
        raise ValueError(f"no response for a revisit of {lost[0]['refers_to']}, sha256 {lost[0]['payload_digest']}")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::bigint AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN first END AS refers_to
FROM f
"""
