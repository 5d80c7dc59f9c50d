"""Web archives: records of pages, a normaliser for archives gzipped as one stream, and reading through a sidecar index.

* `write_pages` writes a record a page into archives of bounded size, each one gzip stream from end to end, as many crawlers leave them.
  Of pages with equal payloads the one with the smallest page_id is a response; the others are revisit records without the payload, which
  name the response and the payload's digest.
* `normalise` inflates such a stream once, front to back, in pieces of bounded size. It rewrites every record as a gzip member of its own
  and writes a sidecar index: file, offset and length of each member, with the record's id. After that a record is read by a seek.
* `read_records` reads archives through their index, a member at a time.

Archives live in the folder that all executors share. A task writes under a name that no other attempt has, and only names that a
finished task returned are read, so a lost executor or a repeated task leaves at most files that nobody reads. The lists of names are
written as tables before they are used.

Nulls: a page without html has an empty payload. A row without a page_id is written with an empty id; it is a revisit if a page with an id
has the same payload, else a response. Rows that repeat a page_id are written again; those with the smallest id of a payload are all
responses. Payloads under SMALL bytes are always responses.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import prepare
from turnstile.session import materialise, scratch_path

SMALL = 100  # bytes; smaller payloads are never revisits
ARCHIVE = 64_000_000  # bytes of records in an archive, or one record
READ = 1 << 20
LEVEL = 4
_DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_RECORD = ("page_id long, record_type string, refers_to long, uri string, payload_digest string, payload_bytes long, "
           "payload binary, file string, offset long, length long")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    body = _HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    uri = (url or "urn:page:").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_text(page_id)}>",
            f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{_text(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _text(number: int | None) -> str:
    return "" if number is None else str(number)


def parse(raw: bytes) -> dict:
    """Header fields of a record, by lower-case name, and its block under an empty name."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    fields[""] = rest[:int(fields["content-length"])]
    return fields


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    path = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri(f"file://{path}")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, whole, holding one record and one chunk at a time."""
    held, need = bytearray(), None
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields = {k.strip().lower(): v for k, _, v in (x.partition(b":") for x in bytes(held[at:end]).split(b"\r\n"))}
                need = end - at + 4 + int(fields[b"content-length"]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at:at + need])
            at, need = at + need, None
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def inflate(source) -> Iterator[bytes]:
    """A gzip file inflated once from front to back, in pieces of bounded size, whether it is one member or several."""
    stream, begun = zlib.decompressobj(31), False
    while data := source.read(READ):
        while data:
            begun = True
            out = stream.decompress(data, READ)
            if out:
                yield out
            if stream.eof:
                data, stream, begun = stream.unused_data, zlib.decompressobj(31), False
            else:
                data = stream.unconsumed_tail
    if begun:
        raise ValueError("the archive ends within a gzip member")


def _member(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write(folder: str, size: int, level: int):
    def run(batches):
        store, base = _place(folder)
        out = packer = name = None
        written = records = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, packer, written, records = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                raw = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"], row["revisit"])
                out.write(packer.compress(raw))
                written, records = written + len(raw), records + 1
                if written >= size:
                    out.write(packer.flush())
                    out.close()
                    yield _names([(name, records)])
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield _names([(name, records)])

    return run


def _names(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], ["file", "records"])


def _normalise(source: str, target: str, level: int):
    def run(batches):
        store, base = _place(source)
        to, there = _place(target)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                made, at, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as archive, \
                        to.open_output_stream(f"{there}/{made}", compression=None) as out, \
                        to.open_output_stream(f"{there}/{made}.idx", compression=None) as index:
                    for raw in split_records(inflate(archive)):
                        member = _member(raw, level)
                        out.write(member)
                        index.write(json.dumps({"id": parse(raw)["warc-record-id"], "offset": at, "length": len(member)}).encode() + b"\n")
                        at, count = at + len(member), count + 1
                yield _names([(made, count)])

    return run


def _read(folder: str, payloads: bool):
    names = [x.split(" ")[0] for x in _RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in _RECORD.split(", ")])

    def run(batches):
        store, base = _place(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{base}/{name}") as archive, store.open_input_stream(f"{base}/{name}.idx", compression=None) as index:
                    for line in _lines(index):
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        rows.append((*_row(zlib.decompress(archive.read(entry["length"]), 31), payloads), name, entry["offset"], entry["length"]))
                        held += len(rows[-1][6] or b"")
                        if len(rows) >= 1000 or held >= 16 * READ:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return run


def _lines(stream) -> Iterator[bytes]:
    left = b""
    while data := stream.read(READ):
        *whole, left = (left + data).split(b"\n")
        yield from whole


def _row(raw: bytes, payloads: bool) -> tuple:
    """A response's payload is measured and hashed as it was read; of a revisit the record states both."""
    fields = parse(raw)
    head, _, payload = fields[""].partition(b"\r\n\r\n")
    kind, refers = fields["warc-type"], fields.get("warc-refers-to")
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size = int(next(x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest = fields["warc-payload-digest"].partition(":")[2]
    return (_id(fields["warc-record-id"]), kind, _id(refers), fields["warc-target-uri"], digest, size,
            payload if payloads and kind == "response" else None)


def _id(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, revisit, refers_to): which pages revisit which."""
    known = pages.selectExpr("cast(page_id as long) as page_id", "url", "html", "sha2(cast(coalesce(html, '') as binary), 256) as digest")
    large = f"coalesce(octet_length(html), 0) >= {SMALL}"
    first = (known.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
             .where("copies > 1").withColumnRenamed("digest", "met"))
    key = f"case when {large} then digest else concat('page ', coalesce(page_id, 0)) end"  # small pages meet nothing, each for itself
    return (known.withColumn("met", F.expr(key)).join(first, "met", "left")
            .withColumn("revisit", F.expr("first is not null and not (page_id <=> first)"))
            .selectExpr("page_id", "url", "html", "digest", "revisit", "case when revisit then first end as refers_to"))


def write_pages(pages: DataFrame, size: int = ARCHIVE, level: int = LEVEL) -> tuple[str, DataFrame]:
    """Writes archives of one gzip stream each. Returns their folder and a table (file, records)."""
    spark = prepare(pages.sparkSession)
    folder = scratch_path(spark, "warc")
    _create(folder)
    return folder, materialise(with_revisits(pages).mapInArrow(_write(folder, size, level), "file string, records long"), "archives")


def normalise(folder: str, archives: DataFrame, level: int = LEVEL) -> tuple[str, DataFrame]:
    """Rewrites archives, each record as its own member with a sidecar index. Returns the new folder and a table (file, records)."""
    spark = prepare(archives.sparkSession)
    target = scratch_path(spark, "warc-members")
    _create(target)
    return target, materialise(_each(archives).mapInArrow(_normalise(folder, target, level), "file string, records long"), "members")


def read_records(folder: str, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, one row each, read member by member through the index."""
    prepare(archives.sparkSession)
    return _each(archives).mapInArrow(_read(folder, payloads), _RECORD)


def _each(archives: DataFrame) -> DataFrame:
    """An archive a task, or a few."""
    spark = archives.sparkSession
    parts = max(1, min(archives.count(), 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return archives.select("file").repartition(parts, F.col("file"))


def _create(folder: str) -> None:
    store, base = _place(folder)
    store.create_dir(base, recursive=True)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from normalised archives."""
    records = read_records(*normalise(*write_pages(pages)), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
