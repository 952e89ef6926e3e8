"""WARC archives written and read on executors, index first.

Writing returns an index of every record: archive, offset, length, URL, digest. Reading starts from the index: the
selected records' byte ranges are sorted and those that lie close together are coalesced into one read each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm import files
from murmuration.llm._common import TEXT_ROWS, Marks, join_groups, located, mapped, work_dir, written

#: Payloads below this many bytes are never revisits.
MIN_REVISIT = 1000
#: An archive is closed and a new one begun after so many bytes; a coalesced read has at most READ_BYTES unless one record is longer, and skips gaps of at most GAP bytes.
ARCHIVE_BYTES, READ_BYTES, GAP = 256 << 20, 8 << 20, 64 << 10

INDEX = "archive string, offset long, length long, url string, digest string, id long, record_type string, refers_to long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"  # pages hold no capture time


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:page"


def _urn(page: int | None) -> str:
    """Record id: of a page id where there is one, so that a revisit can name its response."""
    return uuid.UUID(int=(1 << 64 | page & (1 << 64) - 1) if page is not None else uuid.uuid4().int | 1 << 127).urn


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, target: bool = False) -> bytes:
    """One WARC/1.1 record: a response with an HTTP block, or (target) a revisit of the response with the same payload, whose block is the HTTP head alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _HTTP if target else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if target else 'response'}", f"WARC-Record-ID: <{_urn(page)}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if target:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_urn(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, payload) of one record; a response's payload digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return fields, payload


def plan_revisits(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(file, row, mark): the located pages (id, payload, place) that are to be written as revisits, mark the largest id with an equal payload.

    Only (id, digest, place) are written, grouped and joined by digest, hot digests apart; no payload moves.
    """
    payload = F.encode("payload", "UTF-8")
    known = pages.select("id", F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload)).alias("digest"), "place.*")
    known = written(known.where("id is not null and digest is not null"), folder, "digests")
    groups = known.groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups, folder, "copies")
    return join_groups(known, groups, "digest", "n", known.count()).where("id < largest").select("file", "row", F.col("largest").alias("mark"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write a record for each page and return the index (INDEX), itself a table in the folder.

    Null payloads are empty, null URLs are written as urn:page. Pages with a null id are responses and never targets;
    rows that repeat the largest id of their payload are responses each; very long payloads are written whole, one in
    memory at a time beside its batch. Other columns are not read. Pages are read twice and moved never: which are revisits
    is marked beside the files that hold them. Empty table: empty index.
    """
    rows = located(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")), "place", folder)
    marks = Marks(plan_revisits(rows, folder, min_bytes), f"{folder}/revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, f, at = TaskContext.get().partitionId(), "", None, 0
        for b in batches:
            rows = []
            has, mark = marks.of(b.column(3))
            revisits = [m if h else None for h, m in zip(has.tolist(), mark.tolist(), strict=True)]
            for page, url, payload, to in zip(*(b.column(i).to_pylist() for i in range(3)), revisits, strict=True):
                data = payload.encode("utf-8")
                if f is None:
                    (name, f), at = files.create(folder, f"part-{part:06d}", ".warc"), 0
                rec = record(page, url, data, to, to is not None)
                f.write(rec)
                rows.append((name, at, len(rec), url, hashlib.sha1(data).hexdigest(), page, "response" if to is None else "revisit", to))
                at += len(rec)
                if at >= ARCHIVE_BYTES:
                    f.close()
                    f = None
            if rows:
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "offset", "length", "url", "digest", "id", "record_type", "refers_to"])
        if f is not None:
            f.close()

    return written(mapped(rows, run, INDEX), folder, "index", TEXT_ROWS)


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records that the index rows select: (id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    Rows are dealt by stretches of READ_BYTES of an archive and sorted by offset; neighbours become one range read. A
    revisit's payload is that of the response it refers to, so that only its digest and length are read here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(archive: str, spans: list[tuple[int, int]]) -> list[tuple]:
            rows = []
            with files.open_at(archive) as f:
                begin = spans[0][0]
                data = f.read_at(spans[-1][0] + spans[-1][1] - begin, begin)
            for at, n in spans:
                fields, payload = parse(data[at - begin : at - begin + n])
                number = lambda k, h=fields: int(h[k]) if k in h else None
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                whole = fields["warc-type"] == "response"
                rows.append((number("x-page-id"), fields["warc-target-uri"], len(payload) if whole else number("x-payload-length"), digest, fields["warc-type"], number("x-refers-to-page-id"), payload if whole else None))
            return rows

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            k = 7 if payloads else 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:k], types[:k], strict=True)], names=names[:k])

        now, spans = "", []
        for b in batches:
            for archive, at, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                end = spans[-1][0] + spans[-1][1] if spans else at
                if spans and (archive != now or at - end > GAP or at + n - spans[0][0] > READ_BYTES):
                    yield out(read(now, spans))
                    spans = []
                now = archive
                spans.append((at, n))
        if spans:
            yield out(read(now, spans))

    stretch = F.floor(F.col("offset") / READ_BYTES)
    tasks = int(index.agg(F.sum("length")).first()[0] or 0) // (2 * READ_BYTES) + 1  # by bytes to read, not by the index's size
    dealt = index.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return mapped(dealt, run, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write all pages and read all records back. Empty table: empty result."""
    return read_records(write_archives(pages, work_dir(pages.sparkSession), **columns))
