"""What several operators share: reading tables, settings, and files in the shared folder."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A batch that goes to Python ends at this size, however long its texts are.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 10_000

# Bytes that separate words: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


def prepare(spark: SparkSession, size: int = BATCH_BYTES) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what an operator reads, so that no other column can clash with its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_bucket(doc_id: int | None, buckets: int) -> int:
    """The remainder by which held-out rows are told apart; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % buckets


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_values(column: pa.Array) -> list[str]:
    return [value or "" for value in column.to_pylist()]


def bytes_and_bounds(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all values of a string or binary array without nulls, and where each begins
    and the last ends. Read from the buffers as they are: casts go wrong on slices.
    """
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return memoryview(b""), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return memoryview(data) if data is not None else memoryview(b""), bounds


def byte_views(column: pa.Array) -> list[memoryview]:
    """The bytes of each text, without a copy; null is empty."""
    view, bounds = bytes_and_bounds(pc.fill_null(column, ""))
    return [view[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def give_back() -> None:
    """Return memory that is not used to the system. Spark keeps the processes of Python workers
    for later tasks, and what one has grown to counts for its executor as long as it lives.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work):
    """``work`` over the batches of a task, which leaves no unused memory behind."""
    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


class SharedFiles:
    """Files written by tasks into a folder that every executor reaches.

    A file gets its final name only when it is complete, by a move; a task that runs
    again writes the same content under the same name.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, name: str, chunks) -> int:
        """Write ``chunks`` of bytes; their total length."""
        files, root = self._open()
        files.create_dir(root, recursive=True)
        final = posixpath.join(root, name)
        partial = f"{final}.{uuid.uuid4().hex}.partial"
        total = 0
        with files.open_output_stream(partial) as out:
            for chunk in chunks:
                out.write(chunk)
                total += len(chunk)
        files.move(partial, final)
        return total

    def open(self, name: str):
        files, root = self._open()
        return files.open_input_file(posixpath.join(root, name))
