"""Commit logs and value logs as binary files: encoding records, and decoding up to the first damage, or failing on it.

A commit record is a big-endian checksum (CRC-32C of the rest), key and value lengths
of 16 bits, a type byte, key, sequence number and value.  A value record is a
checksum, two varint lengths, a type byte, key and value.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import crc32c_many
from ..model import ChecksumMismatch

HEAD = struct.Struct(">IHHB")
SEQ = struct.Struct(">Q")


def wal_record(key: bytes, seq: int, value: bytes) -> bytes:
    body = HEAD.pack(0, len(key), len(value), 1)[4:] + key + SEQ.pack(seq) + value
    return struct.pack(">I", int(crc32c_many([body])[0])) + body


def wal_records(data: bytes, strict: bool = False) -> Iterator[tuple[int, bytes, int, bytes]]:
    """``(pos, key, seq, value)`` until the data ends, a record is cut short or its checksum differs; with ``strict`` the last two raise."""
    at, found = 0, []
    while at + HEAD.size <= len(data):
        crc, klen, vlen, kind = HEAD.unpack_from(data, at)
        end = at + HEAD.size + klen + SEQ.size + vlen
        if kind != 1 or end > len(data):
            break
        found.append((at, crc, klen, end))
        at = end
    sums = crc32c_many([data[a + 4 : e] for a, _, _, e in found])
    for (a, crc, klen, end), sum_ in zip(found, sums):
        if crc != sum_:
            damaged(strict, a)
            return
        k = a + HEAD.size
        yield a, data[k : k + klen], SEQ.unpack_from(data, k + klen)[0], data[k + klen + SEQ.size : end]
    if at < len(data):
        damaged(strict, at)


def damaged(strict: bool, at: int) -> None:
    if strict:
        raise ChecksumMismatch(f"the record at {at} is damaged or cut short")


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def value_record(key: bytes, value: bytes) -> bytes:
    body = varint(len(key)) + varint(len(value)) + b"\x01" + key + value
    return struct.pack(">I", int(crc32c_many([body])[0])) + body


def value_records(data: bytes, strict: bool = False) -> Iterator[tuple[int, bytes, bytes]]:
    """``(pos, key, value)``, with the same stops."""
    at = 0

    def number(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return n, i

    while at < len(data):
        try:
            klen, i = number(at + 4)
            vlen, i = number(i)
        except IndexError:
            return damaged(strict, at)
        end = i + 1 + klen + vlen
        if end > len(data) or data[i] != 1 or int(crc32c_many([data[at + 4 : end]])[0]) != struct.unpack_from(">I", data, at)[0]:
            return damaged(strict, at)
        yield at, data[i + 1 : i + 1 + klen], data[i + 1 + klen : end]
        at = end


def read(spark: SparkSession, path: str, suffix: str, strict: bool = False) -> DataFrame:
    """``(fid, pos, key, seq, value)`` of all ``.wal`` files, or ``(fid, pos, key, value)`` of ``.vlog`` files, a file a task at a time."""
    decode, names = (wal_records, ["pos", "key", "seq", "value"]) if suffix == "wal" else (value_records, ["pos", "key", "value"])
    kinds = {"pos": pa.int64(), "key": pa.binary(), "seq": pa.int64(), "value": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fid, content in zip(batch.column("fid").to_pylist(), batch.column("content")):
                rows = list(decode(content.as_py(), strict))
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array([fid] * len(rows), type=pa.int64()), *(pa.array(c, type=kinds[n]) for c, n in zip(columns, names))], names=["fid", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path)
    numbered = files.select(F.regexp_extract("path", rf"([0-9]+)\.{suffix}$", 1).cast("long").alias("fid"), "content")
    return numbered.mapInArrow(run, "fid long, " + ", ".join(f"{n} {'long' if n in ('pos', 'seq') else 'binary'}" for n in names))
