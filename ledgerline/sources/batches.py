"""Record batches: a header, a checksum over what follows it, and records in variable-length numbers; bodies may be compressed."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ledgerline.functions.hashes import crc32c_of

#: Version, checksum; then base offset, base timestamp, number of records, codec; then the records.
HEAD, REST = struct.Struct(">BI"), struct.Struct(">qqIB")
VERSION = 2
CODECS = ("none", "gzip", "snappy", "lz4", "zstd")
#: Bytes that a batch's records may have when they are read.
LARGEST = 64 << 20


def put_varint(out: bytearray, value: int) -> None:
    value = (value << 1) ^ (value >> 63)
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)


def take_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("number is cut short or too long")
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value >> 1 ^ -(value & 1), at


def packed(data: bytes, codec: str) -> bytes:
    """Compressed, after the length that it has otherwise."""
    body = data if codec == "none" else pa.Codec("lz4_raw" if codec == "lz4" else codec).compress(data, asbytes=True)
    return struct.pack(">I", len(data)) + body


def unpacked(data: bytes, codec: str, most: int) -> bytes | None:
    """None if there would be more than ``most`` bytes: the length is checked before anything is read."""
    size = struct.unpack_from(">I", data)[0]
    if size > most:
        return None
    return data[4:] if codec == "none" else pa.Codec("lz4_raw" if codec == "lz4" else codec).decompress(data[4:], size, asbytes=True)


@F.pandas_udf(BinaryType())
def compress(body: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else packed(bytes(b), c) for b, c in zip(body, codec, strict=True)])


@F.pandas_udf(BinaryType())
def decompress(body: pd.Series, codec: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else unpacked(bytes(b), c, m) for b, c, m in zip(body, codec, most, strict=True)])


def encode_batch(base: int, rows: list[tuple], codec: str = "none") -> bytes:
    """rows: (timestamp, numbers...) of consecutive offsets from ``base``; null is written as an absent number."""
    start, body = rows[0][0] if rows else 0, bytearray()
    for when, *numbers in rows:
        put_varint(body, when - start)
        put_varint(body, len(numbers))
        for n in numbers:
            body.append(n is not None)
            if n is not None:
                put_varint(body, n)
    rest = REST.pack(base, start, len(rows), CODECS.index(codec)) + packed(bytes(body), codec)
    return HEAD.pack(VERSION, crc32c_of(rest)) + rest


def restamped(batch: bytes, base: int) -> bytes:
    """The batch with another base offset, and so another checksum."""
    rest = struct.pack(">q", base) + batch[HEAD.size + 8 :]
    return HEAD.pack(VERSION, crc32c_of(rest)) + rest


def decode_batch(batch: bytes) -> list[tuple]:
    """(offset, timestamp, numbers...); ValueError if the batch is damaged."""
    version, crc = HEAD.unpack_from(batch)
    rest = batch[HEAD.size :]
    if version != VERSION or crc32c_of(rest) != crc:
        raise ValueError("not a batch, or a damaged one")
    base, start, count, codec = REST.unpack_from(rest)
    body, at, out = unpacked(rest[REST.size :], CODECS[codec], LARGEST), 0, []
    if body is None:
        raise ValueError("batch too large")
    for i in range(count):
        when, at = take_varint(body, at)
        n, at = take_varint(body, at)
        numbers = []
        for _ in range(n):
            there, at = body[at], at + 1
            value = None
            if there:
                value, at = take_varint(body, at)
            numbers.append(value)
        out.append((base + i, start + when, *numbers))
    return out


def encoded(records: DataFrame, size: int, codec: str = "none") -> DataFrame:
    """(topic, partition, batch): records (topic, partition, offset, timestamp, producer_id, producer_seq) in batches of ``size`` offsets."""

    def batch(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        made = encode_batch(int(rows["offset"].iloc[0]), [tuple(int(x) for x in r) for r in rows[["timestamp", "producer_id", "producer_seq"]].itertuples(index=False)], codec)
        return pd.DataFrame({"topic": [key[0]], "partition": [key[1]], "batch": [made]})

    part = F.floor(F.col("offset") / size).alias("part")
    return records.groupBy("topic", "partition", part).applyInPandas(batch, "topic string, partition int, batch binary")


def decoded(batches: DataFrame) -> DataFrame:
    """The records of ``encoded``, each batch's checksum verified."""

    def rows(parts):
        for part in parts:
            found = [(r.topic, r.partition, *x) for r in part.itertuples(index=False) for x in decode_batch(bytes(r.batch))]
            yield pd.DataFrame(found, columns=["topic", "partition", "offset", "timestamp", "producer_id", "producer_seq"])

    return batches.mapInPandas(rows, "topic string, partition int, offset long, timestamp long, producer_id long, producer_seq long")
