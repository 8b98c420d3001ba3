"""Web archives: records written in segments, read back, reassembled and decoded.

A page becomes one HTTP response whose body is the page's HTML in UTF-8 (NULL: empty), in chunked transfer
framing. Of pages with equal payloads of at least `least_bytes`, the smallest page_id is the response and
the others are revisit records that name it; a page with a NULL page_id is a revisit only of a page that
has one. A response block longer than `segment_bytes` is cut: the first segment stays a response record
with WARC-Segment-Number 1, the others are continuation records, in another archive, that carry the first
record's id and their number, the last one also the total length of the block.

Reading parses each archive as a stream. Whole records go on at once; segments are grouped by origin id,
ordered by number, and must be numbered 1..n and add up to the stated total. Then the HTTP head is cut
off and the chunks are joined. What does not fit (a missing segment, a wrong total, a broken chunk, a
digest that differs) gives a row with `complete` false, the digest and type its header states, and the
number of payload bytes that could be read.

Archives are gzip files with a member per record. A task writes under a name of its attempt and renames,
so lost tasks leave nothing that is read. Repeated page_ids give a record each; equal pages that share the
smallest page_id are all responses. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import Batches, rows_of, slices, tasks
from sievework.session import cut

EOL = b"\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: The list of repeated payloads is sent to all tasks up to this many rows (about 100 bytes each), else joined.
BROADCAST_ROWS = 500_000
_PLACE = uuid.UUID("5f7d4f4e-5c51-5b0c-9a55-6f2f2b1f9c11")
RECORD = "origin string, number int, total long, kind string, page_id long, digest string, refers_to long, block binary"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """(the joined chunks, whether the framing is whole). Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(EOL, at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size == 0:
            return b"".join(out), True
        if size < 0 or body[end + 2 + size : end + 4 + size] != EOL:
            return b"".join(out), False
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _header(value: str | None) -> str | None:
    return None if value is None else re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), value)


def record(kind: str, record_id: str, block: bytes, **fields: str | int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + EOL * 2 + block + EOL * 2


def page_records(place: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                 segment_bytes: int, chunk_bytes: int) -> Iterator[tuple[bool, bytes]]:
    """(whether it is a continuation, the record) of one page. place makes the ids, the same in every attempt."""
    first = str(uuid.uuid5(_PLACE, place))
    known = {"Page_ID": page_id, "WARC_Target_URI": _header(url), "WARC_Payload_Digest": "sha1:" + digest(payload)}
    http = {"Content_Type": "application/http; msgtype=response"}
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield False, record("revisit", first, head, **known, **http, Refers_To_Page_ID=refers_to,
                            WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield False, record("response", first, block, **known, **http)
        return
    yield False, record("response", first, block[:segment_bytes], **known, **http, WARC_Segment_Number=1)
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = at + segment_bytes >= len(block)
        yield True, record("continuation", str(uuid.uuid5(_PLACE, f"{place}/{number}")), block[at : at + segment_bytes],
                           WARC_Segment_Origin_ID=f"<urn:uuid:{first}>", WARC_Segment_Number=number,
                           WARC_Segment_Total_Length=len(block) if last else None)


def _firsts(pages: DataFrame, least_bytes: int) -> DataFrame:
    """payload hash, smallest page_id, of payloads that occur more than once. Counted before the shuffle."""
    return (
        pages.where(F.octet_length("payload") >= least_bytes)
        .groupBy(F.sha1("payload").alias("sha"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("sha", "first")
    )


def write(pages: DataFrame, folder: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
          chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """Writes archives to a mounted shared folder and returns their paths, a few for each task."""
    source = rows_of(
        pages, page_id=pages[id_col].cast("long"), url=pages[url_col].cast("string"),
        payload=F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary"),
    )
    firsts = cut(_firsts(source, least_bytes))
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    refers: Column = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marked = (
        source.withColumn("sha", F.sha1("payload")).join(side, "sha", "left")
        .select("page_id", "url", "payload", refers.alias("refers_to"), F.spark_partition_id().alias("part"))
    )
    os.makedirs(folder, exist_ok=True)

    def run(batches: Batches) -> Batches:
        attempt, files, at, part = uuid.uuid4().hex, {}, 0, -1
        for batch in batches:
            for piece in slices(batch, "payload"):
                rows = zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")))
                part = piece.column("part")[0].as_py()
                for page_id, url, payload, refers_to in rows:
                    for continued, data in page_records(f"{part}/{at}", page_id, url, payload, refers_to, segment_bytes, chunk_bytes):
                        if continued not in files:
                            files[continued] = open(f"{folder}/{attempt}-{int(continued)}", "wb")  # noqa: SIM115
                        files[continued].write(gzip.compress(data, 1, mtime=0))
                    at += 1
        done = []
        for continued, f in files.items():
            f.close()
            done.append(f"{folder}/part-{part:06d}{'-continued' * continued}.warc.gz")
            os.replace(f.name, done[-1])
        if done:
            yield pa.RecordBatch.from_pydict({"path": done})

    return sorted(r.path for r in marked.mapInArrow(run, "path string").collect())


CUT = "cut"


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record. One that is cut short, with the archive or its compressed
    end, comes last, with what there is of it and a field CUT: the bytes its block should have, -1 if not even that is known."""
    while version := _line(stream):
        if not version.strip():
            continue
        if not version.startswith(b"WARC/") and not b"WARC/".startswith(version):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        fields: dict[str, str] = {}
        while (line := _line(stream)).strip():
            name, _, value = line.decode(errors="replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length", 0)) if line else 0
        block = _upto(stream, size)
        if not line or len(block) < size:
            yield fields | {CUT: str(size if line else -1)}, block
            return
        yield fields, block


def _line(stream: BinaryIO) -> bytes:
    """The next line; nothing at the end, also where a compressed stream breaks off."""
    try:
        return stream.readline()
    except EOFError:
        return b""


def _upto(stream: BinaryIO, size: int) -> bytes:
    """As many bytes as there are, size at most."""
    parts, left = [], size
    while left:
        try:
            part = stream.read1(min(left, 1 << 16)) if hasattr(stream, "read1") else stream.read(min(left, 1 << 16))
        except EOFError:
            break
        if not part:
            break
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def _bare(value: str | None) -> str | None:
    return value.strip("<>").removeprefix("urn:uuid:") if value else None


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def read_records(spark: SparkSession, paths: list[str], batch_bytes: int = 16 << 20) -> DataFrame:
    """A row per record of the archives; a task streams through one archive."""
    names = [f.strip().split(" ")[0] for f in RECORD.split(",")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Batches) -> Batches:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with gzip.open(path) as stream:
                    for fields, block in records(stream):
                        rows.append((
                            _bare(fields.get("warc-segment-origin-id") or fields.get("warc-record-id")),
                            _number(fields.get("warc-segment-number")), _number(fields.get("warc-segment-total-length") or fields.get(CUT)),
                            fields.get("warc-type"), _number(fields.get("page-id")),
                            (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                            _number(fields.get("refers-to-page-id")), block,
                        ))
                        size += len(block)
                        if size >= batch_bytes:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return tasks(spark, [(p,) for p in paths], "path string").mapInArrow(run, RECORD)


def payload_of(block: bytes) -> tuple[int, bytes, bool]:
    """(payload bytes that the head states or the body has, body, whether the framing is whole)."""
    head, _, body = block.partition(EOL * 2)
    fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(b":") for line in head.split(EOL)[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body, whole = unchunked(body)
        return len(body), body, whole
    stated = int(fields.get(b"content-length", len(body)))
    return stated, body, len(body) == stated


def reassemble(found: DataFrame) -> DataFrame:
    """A row per page from the rows of read_records. Only segments are shuffled, a group per origin."""
    whole = found.where("number is null").select("kind", "page_id", "digest", "refers_to", F.array(F.struct(F.lit(1).alias("number"), "block")).alias("parts"), F.coalesce("total", F.octet_length("block").cast("long")).alias("total"))
    joined = (
        found.where("number is not null").groupBy("origin")
        .agg(
            F.max(F.when(F.col("number") == 1, F.struct("kind", "page_id", "digest", "refers_to"))).alias("first"),
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        )
        .select("first.*", "parts", "total")
    )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                kind, page_id, stated, refers_to, parts, total = (batch.column(c)[i].as_py() for c in ("kind", "page_id", "digest", "refers_to", "parts", "total"))
                block = b"".join(p["block"] for p in parts)
                complete = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and len(block) == total
                size, payload, framed = payload_of(block)
                if kind == "revisit":
                    complete = complete and not payload
                else:
                    complete = complete and framed and digest(payload) == stated
                rows.append((page_id, size, stated, kind, refers_to, complete))
            if rows:
                names = [f.strip().split(" ")[0] for f in PAGE.split(",")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return whole.unionByName(joined).mapInArrow(run, PAGE)
