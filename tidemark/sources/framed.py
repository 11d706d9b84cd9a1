"""Logs in length-framed files, in any store that Spark reads.

A file is a run of frames: four bytes of length (of what follows, big-endian), eight of position, then the payload. Files lie
under ``first=<position>/last=<position>``, the bounds of what they hold, so that those behind a position are skipped
when the scan is planned. Payloads may be sealed with AES (``readers.read_sealed`` opens them).
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary, first bigint, last bigint"
#: What a frame's length may be.
MOST_BYTES = 100 * 1024 * 1024
OUT = "file string, seqno bigint, payload binary, error string"


def frame(seqno: int, payload: bytes) -> bytes:
    return struct.pack(">iq", len(payload) + 8, seqno) + payload


def frames_of(name: str, content: bytes):
    """file, seqno, payload and error of each frame; what can't be read is one row with its error, and ends the file."""
    at = 0
    while at < len(content):
        head = content[at : at + 4]
        n = struct.unpack(">i", head)[0] if len(head) == 4 else -1
        if len(head) < 4:
            yield name, None, None, f"cut off at byte {at}"
            return
        if not 8 <= n <= MOST_BYTES:
            yield name, None, None, f"no length at byte {at}: {n}"
            return
        if at + 4 + n > len(content):
            yield name, None, None, f"cut off at byte {at}"
            return
        yield name, struct.unpack_from(">q", content, at + 4)[0], content[at + 12 : at + 4 + n], None
        at += 4 + n


def _opened(files: DataFrame, after: int | None) -> DataFrame:
    if after is not None:
        files = files.where(F.col("last") > after)

    def rows(batches):
        names = ["file", "seqno", "payload", "error"]
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held, size = [], 0
                for row in frames_of(name, content):
                    held.append(row)
                    size += len(row[2] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    out = files.select("path", "content").mapInArrow(rows, OUT)
    return out if after is None else out.where(F.col("seqno").isNull() | (F.col("seqno") > after))


def read_frames(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """file, seqno, payload and error of the frames under ``path``, from behind a position."""
    return _opened(spark.read.format("binaryFile").schema(_SCHEMA).load(path), after)


def stream_frames(spark: SparkSession, path: str, after: int | None = None, files: int = 100) -> DataFrame:
    """The same as a stream of files as they come, ``files`` a batch; which were read is in the query's checkpoint."""
    return _opened(spark.readStream.format("binaryFile").schema(_SCHEMA).option("maxFilesPerTrigger", files).load(path), after)
