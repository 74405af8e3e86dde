"""WARC archives as a chunked record table (operator 7).

Writing: every payload becomes rows of (record, chunk number, bytes), so no Python process ever holds a whole
payload. A chunk row carries the SHA-1 of the payload up to and with its bytes; its last one is the payload digest.
Each task streams its rows into one gzip-compressed WARC 1.1 file (a gzip member for each record) under a name of
its own and renames it when it is whole; only files that the manifest table lists count, so a repeated or lost task
leaves no half archive behind. Reading streams the listed files back into the same chunk rows.

Each file begins with a warcinfo record. Records with equal payloads (of equal SHA-1) of at least ``revisit_bytes``:
that with the largest id is the response, the others are revisit records that refer to it. The archive folder may be in any store that pyarrow's file systems or a mounted
path reach.

Defined cases: a null or empty payload is a response with no bytes; a null url is written as an empty target; ids
may repeat only for equal payloads of the same url (each row still gets its record); an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import salted_join, shared_folder, small_batches

CHUNK = 1 << 20
CHUNK_SCHEMA = "page_id long, record_type string, refers_to long, chunk long, data binary, running_sha1 string, last boolean, payload_bytes long"
_MARK = b"WARC/1.1\r\n"
#: Fixed value: the profile of revisits that are told by their payload's digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to. The payload is shuffled once, by digest and salt."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = salted_join(rows, groups, "digest", F.col("page_id"), "_n")
    revisit = F.col("_first").isNotNull() & (F.col("_first") != F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of each payload, in order within its partition; a payload without bytes has one."""
    n = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk)).cast("int")
    rows = records.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    piece = F.substring(F.col("payload"), F.col("chunk") * chunk + 1, F.lit(chunk))
    return rows.select("page_id", "url", "digest", "record_type", "refers_to", "payload_bytes", "chunk", piece.alias("data"), (F.col("chunk") == n - 1).alias("last"))


def _header(page_id, url, kind: str, refers_to, digest: str, size: int) -> bytes:
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Length: {size}", f"Content-Length: {0 if kind == 'revisit' else size}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return _MARK + ("\r\n".join(lines) + "\r\n\r\n").encode()


def _about(level: int) -> bytes:
    """The warcinfo record that begins a file, as a gzip member of its own."""
    body = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(_MARK + ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, store = None, "", 0, None
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path + ".part")
                    out.write(_about(level))
                kind = c["record_type"][i].as_py()
                if c["chunk"][i].as_py() == 0:
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(_header(c["page_id"][i].as_py(), c["url"][i].as_py(), kind, c["refers_to"][i].as_py(), c["digest"][i].as_py(), c["payload_bytes"][i].as_py())))
                    running, size = hashlib.sha1(), 0
                data = c["data"][i].as_py()
                running.update(data)
                size += len(data)
                if kind == "response":
                    out.write(packer.compress(data))
                if c["last"][i].as_py():
                    if running.hexdigest() != c["digest"][i].as_py() or size != c["payload_bytes"][i].as_py():
                        raise ValueError(f"chunks of page {c['page_id'][i]} don't add up to its digest")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    records += 1
        if out is not None:
            out.close()
            store.move(path + ".part", path)
            yield pa.RecordBatch.from_pydict({"name": [path.rsplit("/", 1)[1]], "records": [records]})

    return write


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000, chunk: int = CHUNK, level: int = 1) -> DataFrame:
    """Write pages as archives into folder and return the manifest: name of each file and its number of records."""
    small_batches(pages.sparkSession)
    rows = chunk_rows(plan_records(pages, revisit_bytes), chunk)
    manifest = rows.mapInArrow(_writer(f"{folder}/archives", level), "name string, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("name string, records long").parquet(f"{folder}/manifest")


def _unzipped(source, size: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of all gzip members of a stream, piece by piece."""
    unpack = zlib.decompressobj(31)
    while raw := source.read(size):
        while raw:
            yield unpack.decompress(raw)
            raw = unpack.unused_data if unpack.eof else b""
            if unpack.eof:
                unpack = zlib.decompressobj(31)


def _records(source, chunk: int) -> Iterator[tuple]:
    """(page_id, kind, refers_to, chunk number, bytes, running SHA-1, last, payload bytes) of an archive."""
    pieces, kept = _unzipped(source), bytearray()

    def fill(n: int) -> bool:
        while len(kept) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            kept.extend(piece)
        return True

    def number(text: str | None) -> int | None:
        text = (text or "").removeprefix("<urn:page:").rstrip(">")
        return int(text) if text else None

    while fill(1):
        while (end := kept.find(b"\r\n\r\n")) < 0:
            if not fill(len(kept) + 1):
                raise ValueError("a record header has no end")
        lines = bytes(kept[:end]).decode().split("\r\n")
        del kept[: end + 4]
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        if fields["WARC-Type"] == "warcinfo":
            size = int(fields["Content-Length"]) + 4
            if not fill(size):
                raise ValueError("a record is cut off")
            del kept[:size]
            continue
        left, total, at, running = int(fields["Content-Length"]), int(fields["WARC-Payload-Length"]), 0, hashlib.sha1()
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        head = (number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")))
        while True:
            n = min(left, chunk)
            if not fill(n):
                raise ValueError("a record is cut off")
            data = bytes(kept[:n])
            del kept[:n]
            left -= n
            running.update(data)
            so_far = running.hexdigest() if head[1] == "response" else digest
            if not left and so_far != digest:
                raise ValueError(f"record {head[0]} doesn't match its digest")
            yield (*head, at, data, so_far, not left, total)
            at += 1
            if not left:
                break
        if not fill(4) or kept[:4] != b"\r\n\r\n":
            raise ValueError("a record has no end mark")
        del kept[:4]


def _reader(folder: str, chunk: int, payloads: bool):
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "chunk": pa.int64(), "payload_bytes": pa.int64(), "data": pa.binary(), "last": pa.bool_()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, base = fs.FileSystem.from_uri(f"{folder}/archives")
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for row in _records(source, chunk):
                        rows.append(row if payloads else (*row[:4], b"", *row[5:]))
                        held += len(row[4]) if payloads else 1
                        if held > (1 << 22) or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return read


def read_archives(spark: SparkSession, folder: str, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk rows of all archives that the manifest lists. Without payloads, data is empty but digests are checked."""
    manifest = spark.read.schema("name string, records long").parquet(f"{folder}/manifest")
    return manifest.select("name").mapInArrow(_reader(folder, chunk, payloads), CHUNK_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 1000) -> DataFrame:
    """Write all pages, read the archives back, and return a row for each record as the archive has it."""
    folder = folder or shared_folder(pages.sparkSession)
    write_archives(pages, folder, revisit_bytes)
    rows = read_archives(pages.sparkSession, folder, payloads=False)
    return rows.where("last").select("page_id", "payload_bytes", F.col("running_sha1").alias("payload_digest"), "record_type", "refers_to")
