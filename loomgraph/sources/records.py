"""TFRecord files of Example messages, read and written without their library.

A file is a sequence of framed records (length, checksum, data, checksum).  An Example
is a map from feature names to lists of bytes, floats or integers in protocol-buffer
wire format.  Files are spread over tasks; a file is parsed by one task.
"""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def masked_crc(data: bytes) -> int:
    """The framing's checksum: CRC-32C, rotated and offset."""
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frames(data: bytes, verify: bool = False):
    """The records of a file's bytes."""
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        body = data[at + 12 : at + 12 + n]
        if len(body) < n:
            raise ValueError("a record is cut off")
        if verify and struct.unpack_from("<I", data, at + 12 + n)[0] != masked_crc(body):
            raise ValueError("a record's checksum is wrong")
        yield body
        at += 16 + n


def framed(body: bytes) -> bytes:
    head = struct.pack("<Q", len(body))
    return head + struct.pack("<I", masked_crc(head)) + body + struct.pack("<I", masked_crc(body))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, kind, value


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def decode(example: bytes) -> dict[str, list]:
    """Feature lists by name."""
    out: dict[str, list] = {}
    for _, _, features in _fields(example):
        for _, _, entry in _fields(features):
            parts = {n: v for n, _, v in _fields(entry)}
            values: list = []
            for kind, _, body in _fields(parts.get(2, b"")):
                for _, wire, item in _fields(body):
                    if kind == 1:
                        values.append(item)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(item) // 4}f", item)
                    elif wire == 0:
                        values.append(_signed(item))
                    else:
                        at = 0
                        while at < len(item):
                            v, at = _varint(item, at)
                            values.append(_signed(v))
            out[parts[1].decode()] = values
    return out


def _number(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def _block(field: int, body: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(body)) + body


def encode(features: dict[str, list]) -> bytes:
    """An Example; the kind of a list is that of its first value."""
    entries = b""
    for name, values in sorted(features.items()):
        first = values[0] if values else 0
        if isinstance(first, (bytes, bytearray, str)):
            kind, body = 1, b"".join(_block(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values)
        elif isinstance(first, float):
            kind, body = 2, _block(1, struct.pack(f"<{len(values)}f", *values))
        else:
            kind, body = 3, _block(1, b"".join(_number(int(v)) for v in values))
        entries += _block(1, _block(1, name.encode()) + _block(2, _block(kind, body)))
    return _block(1, entries)


def read_examples(spark: SparkSession, path: str, schema: T.StructType, verify: bool = False) -> DataFrame:
    """Rows of the Examples in the files at ``path``; scalar columns take a list's first value, missing ones null."""

    def value(v: list | None, kind: T.DataType):
        item = kind.elementType if isinstance(kind, T.ArrayType) else kind
        v = [x.decode() if isinstance(item, T.StringType) and isinstance(x, bytes) else x for x in v or []]
        return v if isinstance(kind, T.ArrayType) else (v[0] if v else None)

    def run(batches):
        for b in batches:
            for data in b["content"]:
                rows = [[value(e.get(f.name), f.dataType) for f in schema] for e in map(decode, frames(bytes(data), verify))]
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def encoded(df: DataFrame) -> DataFrame:
    """``(record binary)``: each row as a framed Example; null scalars are left out."""

    def run(batches):
        for b in batches:
            rows = [{n: v if isinstance(v, list) else [v] for n, v in r.items() if v is not None} for r in b.to_pylist()]
            yield pa.record_batch([pa.array([framed(encode(r)) for r in rows], pa.binary())], names=["record"])

    return df.mapInArrow(run, "record binary")


def files_of_records(df: DataFrame, shards: int) -> DataFrame:
    """``(shard, content)``: the bytes of each shard's file; rows are dealt by digest."""
    rows = encoded(df).withColumn("shard", F.pmod(F.xxhash64("record"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").applyInPandas(lambda f: pd.DataFrame({"shard": [f["shard"].iloc[0]], "content": [b"".join(map(bytes, f["record"]))]}), "shard int, content binary")
