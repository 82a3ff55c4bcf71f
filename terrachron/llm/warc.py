"""WARC archives (operator 5): one gzip member per record, written in parallel, read sequentially.

An archive is a table row per block: a warcinfo record and about 8 MB of whole gzip members;
the table is what Spark can write and read in any store. :func:`save_archives` writes the same bytes
as .warc.gz files where a folder is mounted on all machines. The reader inflates member
by member with incremental zlib, frames records by Content-Length and verifies digests.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.plans.tables import written

_BLOCK = 8 << 20
_CHUNK = 1 << 16
#: Repeated digests up to so many are broadcast (about 100 bytes each), so pages needn't be shuffled; more are joined by a shuffle.
_FEW = 200_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class BadRecord(ValueError):
    """A record that is cut short, has no WARC header, or whose digest differs."""


def _clean(value: str) -> str:
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def member(kind: str, date: str, fields: list[tuple[str, str]], body: bytes, name: str | None = None) -> bytes:
    """A gzip member with one record: type, record id (``name``, or one of its own), date, further fields, block."""
    all_ = [("WARC-Type", kind), ("WARC-Record-ID", name or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), *fields]
    all_ += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}"), ("Content-Length", str(len(body)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in all_) + "\r\n").encode() + body + b"\r\n\r\n") + packer.flush()


def warcinfo(date: str) -> bytes:
    return member("warcinfo", date, [("Content-Type", "application/warc-fields")], b"software: terrachron\r\nformat: WARC File Format 1.1\r\n")


def response_id(page: int, digest: str) -> str:
    """Record id of a page's response, which its revisits can name without having met it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str, refers_url: str | None = None) -> bytes:
    """A response record, or a revisit record (HTTP header only) if ``refers`` is given, which names the original's record id, URI and date. Page ids stand in fields of our own as well.

    Of a page whose rows repeat, the responses are one record, written as often, with one id.
    """
    head = HTTP % len(payload)
    fields = [("WARC-Target-URI", _clean(url or "about:blank")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if refers is None:
        return member("response", date, fields, head + payload, None if page is None else response_id(page, digest))
    original = [("WARC-Refers-To", response_id(refers, digest)), ("WARC-Refers-To-Target-URI", _clean(refers_url or "about:blank")), ("WARC-Refers-To-Date", date)]
    return member("revisit", date, [*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *original, ("X-Refers-To-Page-ID", str(refers))], head)


def members(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of consecutive blocks; a member may span blocks."""
    inflate, out, begun = zlib.decompressobj(31), [], False
    for block in blocks:
        view = memoryview(block)
        for at in range(0, len(view), _CHUNK):
            data = bytes(view[at : at + _CHUNK])
            while data:
                out.append(inflate.decompress(data))
                begun, data = True, inflate.unused_data
                if inflate.eof:
                    yield b"".join(out)
                    inflate, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise BadRecord("the last gzip member is cut short")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block; Content-Length and digests are verified."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError):
        raise BadRecord("no Content-Length") from None
    body = rest[:size]
    if len(body) != size or rest[size:] != b"\r\n\r\n":
        raise BadRecord("the block doesn't have its Content-Length")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha256:" + hashlib.sha256(body).hexdigest():
        raise BadRecord("block digest differs")
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload_of(body)[0]).hexdigest():
        raise BadRecord("payload digest differs")
    return fields, body


def payload_of(body: bytes) -> tuple[bytes, int]:
    """(payload, its length by the HTTP header) of a block; a revisit's payload is left out, its length is not."""
    head, sep, payload = body.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length: *(\d+) *\r?$", head)
    if not sep or not said:
        raise BadRecord("no HTTP header")
    return payload, int(said[1])


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, html) -> page_id, url, html, digest, refers_to (null: response), refers_url (the original's); urls and html as bytes.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response;
    rows that repeat that page_id too are responses as well. A null page_id is never
    referred to; where all ids of equal payloads are null, all are responses. Null html
    is empty; other columns are ignored. Digests are counted without the html, and only
    those that repeat meet the pages: broadcast where they are few, else by a shuffle,
    in which AQE splits a digest that very many pages have.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").cast("binary").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    counted = own.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first_url"), F.count("*").alias("n"))
    repeated = written(counted.where("n > 1").select("digest", "first", "first_url"), "warc-repeated")
    few = repeated.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("first_url")), F.lit(0))).first()
    if few[0] <= _FEW and few[1] <= _FEW * 100:
        repeated = F.broadcast(repeated)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return own.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("first_url")).alias("refers_url"))


def write_archives(rows: DataFrame, date: str | None = None) -> DataFrame:
    """Output of :func:`with_revisits` -> a written table (archive, block, data): each task writes archives of its own.

    ``date`` (ISO, UTC) is the records' WARC-Date, by default now. Repeated rows and rows
    with null ids have records of their own; URLs that are null are about:blank, and bytes
    that can't stand in a header are percent-encoded. No rows make no archive.
    """
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, block, out, size = uuid.uuid4().hex, 0, [], 0

        def flush() -> pa.RecordBatch:
            data = warcinfo(when) + b"".join(out)
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["archive", "block", "data"])

        for b in batches:
            for page, url, html, digest, refers, original in zip(*(b.column(i) for i in range(6)), strict=True):
                out.append(record(page.as_py(), (url.as_py() or b"").decode("utf-8", "replace"), html.as_py(), digest.as_py(), refers.as_py(), when, (original.as_py() or b"").decode("utf-8", "replace")))
                size += len(out[-1])
                if size >= _BLOCK:
                    yield flush()
                    block, out, size = block + 1, [], 0
        if out:
            yield flush()

    return written(rows.mapInArrow(run, "archive string, block long, data binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """(archive, block, data) -> page_id, payload_bytes, payload_digest, record_type, refers_to: a row per response and revisit.

    Lengths come from the framed payload, a revisit's from the HTTP header that it keeps.
    A bad record fails the task; a null block has no records; repeated blocks are read
    again. A block holds whole members, so blocks are read in parallel.
    """

    def row(fields: dict[str, str], body: bytes) -> tuple:
        payload, size = payload_of(body)
        if fields["warc-type"] == "response":
            size = len(payload)
        number = lambda k: int(fields[k]) if k in fields else None
        return number("x-page-id"), size, fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], number("x-refers-to-page-id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            for block in b.column(0):
                records = map(parse, members(iter([block.as_py() or b""])))
                cols = list(zip(*(row(*r) for r in records if r[0]["warc-type"] in ("response", "revisit")), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("data").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each block as ``folder``/archive-block.warc.gz (a folder mounted on all machines) -> path, bytes.

    Files appear under their final name only when whole, so a task that runs twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for archive, block, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                path = f"{folder}/{archive}-{block:05d}.warc.gz"
                with open(part := f"{path}.{uuid.uuid4().hex}.part", "wb") as f:
                    f.write(data)
                os.replace(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64())], ["path", "bytes"])

    return archives.select("archive", "block", "data").mapInArrow(run, "path string, bytes long")


def load_archives(paths: DataFrame) -> DataFrame:
    """Output of ``spark.read.format("binaryFile")`` over .warc.gz files -> as :func:`read_archives`."""
    return read_archives(paths.select(F.col("path").alias("archive"), F.lit(0).cast("long").alias("block"), F.col("content").alias("data")))
