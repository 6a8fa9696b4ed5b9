"""WARC archives: write pages as records, normalise whole-file gzip, read records back by index.

An archive is first one gzip stream. The normaliser inflates such a stream once, rewrites every record
as a gzip member of its own and writes a sidecar index of offsets, so that one record can be read
without the rest. Archives lie in a folder that all executors reach (any that pyarrow.fs opens).
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, shared_dir, stored

#: An archive is closed once it holds so many bytes of payload.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<{uuid.uuid5(NAMESPACE, f'page:{page}').urn}>"


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, first: bool, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if first else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"WARC-Page-ID: {page}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if not first:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    """Fields of a WARC or HTTP header, names in lower case."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs if name.strip()}


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one member or many, CHUNK at a time; raises EOFError if it is cut short."""
    machine, inside = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            inside = True
            data = machine.decompress(chunk, CHUNK)
            if data:
                yield data
            if machine.eof:
                chunk, machine, inside = machine.unused_data, zlib.decompressobj(31), False
            elif machine.unconsumed_tail:
                chunk = machine.unconsumed_tail
            elif len(data) == CHUNK:  # there may be more inside
                chunk = b""
                while data := machine.decompress(b"", CHUNK):
                    yield data
                if machine.eof:
                    chunk, machine, inside = machine.unused_data, zlib.decompressobj(31), False
            else:
                chunk = b""
    if inside:
        raise EOFError("gzip stream ends inside a member")


def normalise(chunks: Iterable[bytes], write, level: int = 6) -> Iterator[dict]:
    """Rewrite the records of a gzip stream as members of their own; yields an index entry for each.

    write takes the bytes of the new archive. Only one record's header and CHUNK bytes of its block
    are held at a time.
    """
    source, held, offset = inflate(chunks), b"", 0
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(source, None)
            if more is None:
                if held.strip():
                    raise EOFError("archive ends inside a record's header")
                return
            held += more
        fields = headers_of(held[:end])
        left = end + 4 + int(fields["content-length"]) + 4
        packer, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        while left:
            if not held:
                held = next(source, b"")
                if not held:
                    raise EOFError("archive ends inside a record")
            part, held = held[:left], held[left:]
            left -= len(part)
            packed = packer.compress(part)
            write(packed)
            length += len(packed)
        packed = packer.flush()
        write(packed)
        length += len(packed)
        yield {"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "offset": offset, "length": length}
        offset += length


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers_of(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, headers_of(http), payload


def _attempt() -> str:
    """A name of its own for each try of a task: what a lost try left behind is never taken for whole."""
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def mark_revisits(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, first_id, is_first): first_id is the least id among equal payloads.

    Null html is an empty payload. Rows that repeat the least id are all first, and so are all rows of
    a payload that no id is known for. Ids are whole numbers. Only digests that occur more than once are
    joined: payloads stay where they are while Spark can broadcast those, and a common one can be split
    where it can't.
    """
    plain = pages.select(
        F.col(id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    counted = plain.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    several = stored(counted.where("n > 1").select("digest", "least"), "several")
    joined = plain.join(several, "digest", "left").withColumn("first_id", F.coalesce("least", "page_id"))
    first = F.col("first_id").isNull() | F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    return joined.select("page_id", "url", "payload", "first_id", first.alias("is_first"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write rows of mark_revisits() as archives of one gzip stream each; returns (archive, records), stored."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, packer, size, records, number, path = None, None, 0, 0, 0, ""
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.write(packer.flush())
            out.close()
            done.append((path, records))

        for batch in batches:
            for page, url, payload, first_id, is_first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path = f"{_attempt()}-{number:04d}"
                    out = system.open_output_stream(f"{root}/{path}.mono.gz", compression=None)
                    packer, size, records, number = zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0, number + 1
                record = make_record(page, url, payload, first_id, is_first)
                out.write(packer.compress(record))
                size += len(record)
                records += 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records"])

    bounded_batches(marked.sparkSession)
    return stored(marked.mapInArrow(of, "archive string, records bigint"), "archives")


def normalise_archives(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalise each archive of write_archives() into NAME.warc.gz with NAME.idx; returns (archive, records), stored.

    The stream archive is removed only after this table is written, by nobody here: a lost task can
    run again.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            done = []
            for name in batch.column(0).to_pylist():
                out_name = f"{name}-{_attempt()}"
                records = 0
                with (
                    system.open_input_stream(f"{root}/{name}.mono.gz", compression=None) as source,
                    system.open_output_stream(f"{root}/{out_name}.warc.gz", compression=None) as out,
                    system.open_output_stream(f"{root}/{out_name}.idx") as index,
                ):
                    for entry in normalise(iter(lambda: source.read(CHUNK), b""), out.write, level):
                        index.write(json.dumps(entry, separators=(",", ":")).encode() + b"\n")
                        records += 1
                done.append((out_name, records))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records"])

    # the shuffle that dealt out the pages isn't needed any more: let Spark drop its files before more are written
    gc.collect()
    archives.sparkSession.sparkContext._jvm.System.gc()
    n = max(1, archives.count())
    dealt = archives.repartition(min(n, 4096))
    return stored(dealt.mapInArrow(of, "archive string, records bigint"), "normalised")


RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of normalised archives, each read by its index entry.

    payload is null for revisits. Bytes and digest are those of the full payload: measured on responses
    (a digest that differs from the record's raises), as recorded on revisits.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_file(f"{root}/{name}.warc.gz") as archive, system.open_input_stream(f"{root}/{name}.idx") as index:
                    for line in index.read().splitlines():
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        fields, http, payload = parse_record(zlib.decompress(archive.read(entry["length"]), 31))
                        first, digest = fields["warc-type"] == "response", fields["warc-payload-digest"].removeprefix("sha1:")
                        if first and digest_of(payload) != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} in {name} differs from its digest")
                        page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                        rows.append(
                            (
                                int(page) if page else None,
                                fields.get("warc-target-uri"),
                                payload if first and with_payload else None,
                                len(payload) if first else int(http["content-length"]),
                                digest,
                                fields["warc-type"],
                                int(refers) if refers else None,
                            )
                        )
                        size += len(payload)
                        if len(rows) >= 2048 or size >= CHUNK * 16:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    n = max(1, archives.count())
    return archives.repartition(min(n, 4096)).mapInArrow(of, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, folder: str | None = None, with_payload: bool = True) -> DataFrame:
    """Write pages to archives in folder, normalise them and read all records back; one row per page, see RECORDS.

    Null html is an empty payload, null ids and urls come back null, repeated rows stay (see mark_revisits());
    an empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    folder = folder or archive_folder(spark)
    written = normalise_archives(write_archives(mark_revisits(pages), folder), folder)
    return read_archives(written, folder, with_payload)
