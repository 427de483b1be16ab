"""Zstandard web archives: written from pages, read back record by record (operator 8).

An archive (``.warc.zst``) begins with a skippable frame that holds a dictionary, which
may be empty; then comes one zstandard frame per record. A page whose payload another
page has already stored is a ``revisit`` record without the payload.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SharedFiles
from tidemark.session import run_folder, staged

SKIPPABLE = 0x184D2A5D
LEVEL = 3
ARCHIVE_BYTES = 64 << 20  # an archive ends at the first record beyond this size
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10  # what each archive's dictionary is built from
LEAST_REVISIT = 100  # shorter payloads are stored again
PIECE = 64 << 10

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = re.compile(r"<urn:page:(null|-?[0-9]+)>")
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def of_urn(urn: str) -> int | None:
    found = RECORD_ID.fullmatch(urn)
    if not found:
        raise ValueError(f"no page id in {urn!r}")
    return None if found[1] == "null" else int(found[1])


def head(lines: list[tuple[str, object]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines), "", ""]).encode()


def page_record(page_id, url, payload: bytes, refers_to=None, revisit=False) -> bytes:
    """One record, its header, block and closing blank lines."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("X-Payload-Length", len(payload)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "%20", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_urn(refers_to))]
    block = head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))],
                 "HTTP/1.1 200 OK") + (b"" if revisit else payload)
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return head(fields, "WARC/1.1") + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]):
    """A dictionary of the samples, or None where they are too few for one."""
    import zstandard

    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES or len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        return None


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of one archive; the dictionary is built from its first records."""
    import zstandard

    samples: list[bytes] = []
    held = 0
    for record in records:
        samples.append(record)
        held += len(record)
        if held >= SAMPLE_BYTES:
            break
    dictionary = build_dictionary(samples)
    content = dictionary.as_bytes() if dictionary else b""
    yield struct.pack("<II", SKIPPABLE, len(content)) + content
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    for record in samples:
        yield packer.compress(record)
    samples.clear()
    for record in records:
        yield packer.compress(record)


def frames(file) -> Iterator[bytes]:
    """The content of each frame of an archive, read piece by piece."""
    import zstandard

    start = file.read(8)
    magic, length = struct.unpack("<II", start) if len(start) == 8 else (0, 0)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    content = file.read(length)
    if len(content) != length:
        raise ValueError("the dictionary frame is cut short")
    dictionary = zstandard.ZstdCompressionDict(content) if content else None
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    data = file.read(PIECE)
    while data:
        frame, parts = opener.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or file.read(PIECE)
                break
            data = file.read(PIECE)
            if not data:
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def headers(data: bytes, first: str) -> tuple[dict[str, str], int]:
    """The fields of a header that begins with ``first``, and where it ends."""
    end = data.find(b"\r\n\r\n")
    lines = data[:max(end, 0)].decode().split("\r\n")
    if end < 0 or lines[0] != first:
        raise ValueError(f"no {first} header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name] = value
    return fields, end + 4


def parse(record: bytes) -> dict:
    """The fields of a record; raises ValueError where a header or a length is wrong."""
    fields, at = headers(record, "WARC/1.1")
    if lacking := [name for name in REQUIRED if name not in fields]:
        raise ValueError(f"the header lacks {', '.join(lacking)}")
    block = record[at:-4]
    if len(record) < at + 4 or record[-4:] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("the length of the block is wrong")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown record type {kind}")
    http, at = headers(block, "HTTP/1.1 200 OK")
    payload, said = block[at:], int(fields["X-Payload-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if int(http["Content-Length"]) != said or len(payload) != (said if kind == "response" else 0):
        raise ValueError("the length of the payload is wrong")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("the digest of the payload is wrong")
    return {
        "page_id": of_urn(fields["WARC-Record-ID"]), "payload_bytes": said,
        "payload_digest": digest, "record_type": kind,
        "refers_to": of_urn(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "url": fields.get("WARC-Target-URI"), "payload": payload, "error": None,
    }


def pages_with_digest(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload a smaller page_id holds.

    Sizes and digests are summed up per digest before they are shuffled, so a payload that
    a third of all pages share reaches its task as one row per map task; only the rows of
    payloads that come more than once are joined.
    """
    rows = pages.select("page_id", "digest", F.octet_length("html").alias("n")).filter(
        F.col("n") >= LEAST_REVISIT)
    first = rows.groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count("*").alias("copies")
    ).filter("copies > 1").drop("copies")
    return staged(
        rows.join(staged(first, "shared-payloads"), "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "digest", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame) -> tuple[SharedFiles, DataFrame]:
    """Write one record per row of ``pages``; the files and their list: name, records.

    The payload is ``html`` in UTF-8, null being empty. Of equal payloads of at least 100
    bytes, that of the smallest page_id is stored and others refer to it; a null page_id
    counts as the largest, and rows that repeat the smallest page_id are stored again.
    """
    rows = pages_with_digest(pages)
    seen = revisits(rows).withColumnRenamed("page_id", "other").withColumnRenamed("digest", "same")
    rows = rows.join(
        seen, (rows.digest == seen.same) & rows.page_id.eqNullSafe(seen.other), "left"
    ).select("page_id", "url", "html", seen.same.isNotNull().alias("revisit"), "refers_to")
    files = SharedFiles(run_folder(pages.sparkSession, "archives"))

    def write(batches):
        run = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        waiting = (r for b in batches for r in b.to_pylist())
        following = next(waiting, None)
        number = 0
        while following is not None:
            name, count, size = f"pages-{run}-{number:04d}.warc.zst", 0, 0

            def records():
                nonlocal following, count, size
                while following is not None and size < ARCHIVE_BYTES:
                    row = following
                    record = page_record(row["page_id"], row["url"], row["html"].encode(),
                                         row["refers_to"], row["revisit"])
                    count, size = count + 1, size + len(record)
                    following = next(waiting, None)
                    yield record

            files.write(name, archive(records()))
            yield pa.RecordBatch.from_pylist([{"name": name, "records": count}])
            number += 1

    return files, staged(rows.mapInArrow(write, "name string, records long"), "archive-list")


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: SharedFiles, names: DataFrame, payload: bool = False) -> DataFrame:
    """One row per record; with ``payload``, also url, payload, and the reason in ``error``
    where a record is not valid. Without it an invalid record ends the job.
    """
    columns = COLUMNS + (["url", "payload", "error"] if payload else [])
    schema = SCHEMA + (", url string, payload binary, error string" if payload else "")

    def rows(name):
        with files.open(name) as file:
            for frame in frames(file):
                try:
                    yield parse(frame)
                except ValueError as why:
                    if not payload:
                        raise
                    yield dict.fromkeys(columns) | {"payload": frame, "error": str(why)}

    def read(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(name):
                    held.append([row[c] for c in columns])
                    size += len(row["payload"] or b"") if payload else 100
                    if size > PIECE * 64:
                        yield arrow(held, types)
                        held, size = [], 0
                if held:
                    yield arrow(held, types)

    def arrow(held, types):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=False)], columns)

    return names.select("name").repartition(max(1, names.count())).mapInArrow(read, schema)


def archives(pages: DataFrame) -> DataFrame:
    """Write archives and read them back: one row per page. An empty table gives no rows."""
    return read_archives(*write_archives(pages))
