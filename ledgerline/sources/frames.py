"""Framed record files: a checksum for each frame, and what a torn or damaged end means."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Two magic bytes, version, flags, payload length, CRC-32 of the payload; then the payload.
HEAD = struct.Struct("<2sBBII")
MAGIC, VERSION, LARGEST = b"LG", 1, 16 << 20


def encode(payload: bytes, flags: int = 0) -> bytes:
    if len(payload) > LARGEST:
        raise ValueError("payload too large")
    return HEAD.pack(MAGIC, VERSION, flags, len(payload), zlib.crc32(payload)) + payload


def decode(data: bytes, at: int = 0) -> tuple[bytes, int] | None:
    """(payload, end) of the frame at a place; None if more bytes are needed; ValueError if it is damaged."""
    if len(data) - at < HEAD.size:
        return None
    magic, version, _, size, crc = HEAD.unpack_from(data, at)
    if magic != MAGIC or version != VERSION or size > LARGEST:
        raise ValueError("not a frame")
    end = at + HEAD.size + size
    if end > len(data):
        return None
    payload = data[at + HEAD.size : end]
    if zlib.crc32(payload) != crc:
        raise ValueError("checksum differs")
    return payload, end


def scan(data: bytes) -> tuple[list[bytes], str]:
    """The longest valid prefix, and how it ends: Clean, Torn (nothing intact follows) or Fault (an intact frame does)."""
    out, at = [], 0
    while at < len(data):
        try:
            got = decode(data, at)
        except ValueError:
            got = None
        if got is None:
            return out, "Fault" if _intact_after(data, at + 1) else "Torn"
        out.append(got[0])
        at = got[1]
    return out, "Clean"


def _intact_after(data: bytes, at: int) -> bool:
    while (at := data.find(MAGIC, at)) >= 0:
        try:
            if decode(data, at) is not None:
                return True
        except ValueError:
            pass
        at += 1
    return False


def scan_frames(files: DataFrame) -> DataFrame:
    """files: path, content. (path, offset (dense within a file), payload, ending); a file without an intact frame gives one row with a null payload."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, ending = scan(content)
                rows = found or [None]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)) if found else [None], pa.int64()), pa.array(rows, pa.binary()), pa.array([ending] * len(rows))], ["path", "offset", "payload", "ending"])

    return files.select("path", "content").mapInArrow(frames, "path string, offset long, payload binary, ending string")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``scan_frames`` of the files under a path."""
    return scan_frames(spark.read.format("binaryFile").load(path))
