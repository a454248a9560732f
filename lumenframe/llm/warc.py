"""WARC archives: whole-file gzip streams rewritten with one member per record.

An archive compressed as one stream can only be read from its start. The
normaliser inflates such a stream once, rewrites each record as its own gzip
member and writes a sidecar index of offsets, so that any record can be read
alone. Archives are rows ``path, content`` (the columns of Spark's binaryFile
source, which can read existing ``.warc.gz`` files) and are stored as Parquet,
because Spark has no sink for plain binary files; the sidecar is a table of its own
with a row a record, ``path, record_id, type, offset, size``, and reading seeks by it.

Equal payloads of at least ``revisit_bytes`` are stored once: the record with the
smallest id is the response, the others are revisits with its digest and id.

Defined results: a null page is an empty payload; rows with equal page_id each
get a record; among rows without page_id no record is a response for others
unless all its copies lack one; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import beside_group, bounded, fresh_path, removed

VERSION, EOL = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An own field: the payload's length, which a revisit would else have to ask of its response.
LENGTH = "X-Payload-Length"
#: Records carry a fixed date, so that equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archives:
    """``archive_bytes`` bounds the records of one archive, and so a task's memory."""

    archive_bytes: int = 8 << 20
    revisit_bytes: int = 100
    level: int = 6


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return EOL.join(lines) + EOL + EOL + block + EOL + EOL


def header_value(text: str | None) -> str:
    """A value without line breaks."""
    return re.sub(r"[\r\n]+", " ", text or "")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = [
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", header_value(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), (LENGTH, str(len(payload))),
    ]
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        return record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], block)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Content-Type", "application/http; msgtype=response")]
    return record("revisit", headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


class Damaged(ValueError):
    """An archive that isn't a sequence of whole records."""


def inflated(content: bytes | pa.Buffer, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file, in pieces, over all its members."""
    view, engine = memoryview(content), zlib.decompressobj(31)
    for at in range(0, len(view), step):
        data = view[at : at + step]
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            out = engine.decompress(data)
            if out:
                yield out
            data = engine.unused_data
    if len(view) and not engine.eof:
        raise Damaged("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream, one in memory at a time."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        end = held.find(EOL + EOL)
        while end < 0:
            if not fill(len(held) + 1):
                raise Damaged("a record's headers end early")
            end = held.find(EOL + EOL)
        head = bytes(held[:end])
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        if not head.startswith(b"WARC/") or not length:
            raise Damaged("not a WARC record")
        size = end + 4 + int(length[1]) + 4
        if not fill(size):
            raise Damaged("a record's block ends early")
        yield bytes(held[:size])
        del held[:size]


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(EOL + EOL)
    headers = {}
    for line in head.split(EOL)[1:]:
        k, _, v = line.decode().partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, rest[: int(headers["content-length"])]


def member(data: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def deduplicated(pages: DataFrame, how: Archives) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` per row."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = bounded(pages).select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= how.revisit_bytes
    own = own.withColumn("large", large)
    # Copies meet by digest without their payloads, partly grouped before the shuffle;
    # payloads travel by page, so that no key holds a group of copies.
    ids = own.where("large").select("digest", "page_id")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("first is not null and n > 1")
    later = beside_group(ids.distinct(), first, "digest").where("page_id is null or page_id > first")
    later = later.select(F.col("digest").alias("later_digest"), F.col("page_id").alias("later_id"), "first")
    joined = own.join(later, F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("digest") == F.col("later_digest")), "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, how: Archives = Archives()) -> str:
    """Write ``pages`` as archives, each one gzip stream: rows ``path, content``."""
    rows = deduplicated(pages, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def named() -> str:
            return f"part-{part:05d}-{number:05d}.warc.gz"

        def begun() -> tuple[list[bytes], object, int]:
            engine = zlib.compressobj(how.level, zlib.DEFLATED, 31)
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:file:{named()}>"), ("WARC-Date", DATE), ("WARC-Filename", named()), ("Content-Type", "application/warc-fields")], b"software: lumenframe\r\n")
            return [engine.compress(info)], engine, len(info)

        def closed(out: list[bytes], engine) -> pa.RecordBatch:
            out.append(engine.flush())
            return pa.RecordBatch.from_arrays([pa.array([named()]), pa.array([b"".join(out)], pa.binary())], names=["path", "content"])

        out, engine, size = None, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if out is None:
                        out, engine, size = begun()
                    raw = page_record(page_id, url, payload, digest, refers)
                    out.append(engine.compress(raw))
                    size += len(raw)
                    if size >= how.archive_bytes:
                        yield closed(out, engine)
                        out, number = None, number + 1
        if out is not None:
            yield closed(out, engine)

    rows.mapInArrow(run, "path string, content binary").write.parquet(path)
    return path


STORED = "kind string, path string, content binary, record_id string, type string, offset long, size long"


def normalise(archives: DataFrame, path: str, level: int = 6) -> str:
    """Rewrite archives ``path, content`` with a member per record.

    Under ``path``, in one narrow pass that reads an archive once from its start:
    ``kind=archive`` with ``path, content`` and the sidecar ``kind=index`` with a row a
    record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STORED.split(", ")]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                own, out, at, rows = name.as_py(), [], 0, []
                for raw in records(inflated(content.as_buffer())):
                    headers, _ = parsed(raw)
                    packed = member(raw, level)
                    out.append(packed)
                    rows.append(("index", own, None, headers.get("warc-record-id", ""), headers.get("warc-type", ""), at, len(packed)))
                    at += len(packed)
                rows.append(("archive", own, b"".join(out), None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    bounded(archives).select("path", "content").mapInArrow(run, STORED).write.partitionBy("kind").parquet(path)
    return path


def stored_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of normalised archives."""
    return spark.read.schema(STORED).parquet(path).where("kind = 'archive'").select("path", "content")


def offset_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar ``path, record_id, type, offset, size``, without archives' bytes."""
    return spark.read.schema(STORED).parquet(path).where("kind = 'index'").select("path", "record_id", "type", "offset", "size")


def read_pages(archives: DataFrame, index: DataFrame, with_payloads: bool = True) -> DataFrame:
    """``page_id, url, type, digest, refers_to, payload_bytes, payload`` per page record of
    ``index``, each read alone at its offset; a response's payload must match its digest.
    ``payload_bytes`` is the whole payload's, for a revisit as its record says."""
    names = ["page_id", "url", "type", "digest", "refers_to", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    if not with_payloads:
        names, kinds = names[:-1], kinds[:-1]

    def size_of(headers: dict[str, str], payload: bytes | None) -> int | None:
        said = headers.get(LENGTH.lower())
        if payload is not None and said not in (None, str(len(payload))):
            raise Damaged(f"length of {headers['warc-record-id']}")
        return len(payload) if payload is not None else None if said is None else int(said)

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, seeks in zip(*batch.columns, strict=True):
                data, rows = memoryview(content.as_buffer()), []
                for seek in seeks.as_py():
                    at, size, kind = seek["offset"], seek["size"], seek["type"]
                    headers, block = parsed(zlib.decompress(data[at : at + size], 31))
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    payload = block.partition(EOL + EOL)[2] if kind == "response" else None
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise Damaged(f"payload of {headers['warc-record-id']}")
                    rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], kind, digest, number(headers.get("warc-refers-to")), size_of(headers, payload), *([payload] if with_payloads else [])))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # An archive is of bounded bytes, so its entries are of a bounded number.
    pages = index.where("type in ('response', 'revisit')")
    seeks = pages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", "size", "type"))).alias("seeks"))
    own = archives.join(seeks, "path").select("content", "seeks")
    schema = "page_id long, url string, type string, digest string, refers_to long, payload_bytes long"
    return own.mapInArrow(run, schema + ", payload binary" * with_payloads)


def round_trip(pages: DataFrame, path: str | None = None, how: Archives = Archives()) -> DataFrame:
    """Write, normalise and read back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``. Without a ``path`` the whole-file streams are deleted once
    they are normalised."""
    spark = pages.sparkSession
    where = path or fresh_path(spark, "warc")
    write_archives(pages, f"{where}/streams", how)
    normalise(spark.read.parquet(f"{where}/streams"), f"{where}/records", how.level)
    if path is None:  # nothing reads the streams any more
        removed(spark, f"{where}/streams")
    read = read_pages(stored_archives(spark, f"{where}/records"), offset_index(spark, f"{where}/records"), with_payloads=False)
    return read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
