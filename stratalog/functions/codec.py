"""Byte codecs: varints, big-endian integers, internal keys, tagged values; bytes as BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import INLINE, INLINE_LIMIT, POINTER, POINTER_BYTES
from .ordering import as_column


def big_endian(n: str | Column, size: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(as_column(n).cast("long")), 2 * size, "0"))


def from_big_endian(data: str | Column) -> Column:
    return F.conv(F.hex(as_column(data)), 16, 10).cast("decimal(20,0)")


def varint_length(n: str | Column) -> Column:
    """Bytes of a base-128 varint."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(as_column(n) < F.lit(1 << (7 * k)), k).otherwise(out)
    return F.when(as_column(n) < 0, 10).otherwise(out)


def varint(n: str | Column) -> Column:
    """Little-endian groups of seven bits; all but the last have the high bit set."""
    n = as_column(n).cast("long")
    size = varint_length(n)
    part = lambda i: F.call_function("shiftrightunsigned", n, (i * 7).cast("int")).bitwiseAND(127)
    digits = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(part(i) + F.when(i < size - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def read_varint(data: str | Column, at: Column | int = 1, bits: int = 64) -> Column:
    """A struct of the value and the bytes it takes, from a one-based place."""
    code = F.hex(as_column(data))
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda i: F.conv(F.substring(code, (2 * (at + i) - 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        b = byte(i)
        value = s["value"].bitwiseOR(F.call_function("shiftleft", b.bitwiseAND(127), (i * 7).cast("int")))
        return F.when(s["done"] | b.isNull(), F.struct(s["value"].alias("value"), s["size"].alias("size"), F.lit(True).alias("done"))).otherwise(F.struct(value.alias("value"), (s["size"] + 1).alias("size"), (b < 128).alias("done")))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(9)), start, step)
    value = out["value"].bitwiseAND((1 << 32) - 1) if bits == 32 else out["value"]
    return F.struct(value.alias("value"), out["size"].alias("size"))


def length_prefixed(data: str | Column) -> Column:
    data = as_column(data)
    return F.concat(varint(F.octet_length(data)), data)


def read_length_prefixed(data: str | Column) -> Column:
    data = as_column(data)
    head = read_varint(data)
    return F.substring(data, head["size"] + 1, head["value"].cast("int"))


def internal_key(key: str | Column, seq: str | Column) -> Column:
    """Length, key, and eight bytes of the sequence number above a type byte of 1."""
    key = as_column(key)
    return F.concat(varint(F.octet_length(key) + 8), key, big_endian(F.call_function("shiftleft", as_column(seq).cast("long"), F.lit(8)).bitwiseOR(1)))


def parse_internal_key(data: str | Column) -> Column:
    """A struct ``(key, seq)``."""
    body = read_length_prefixed(data)
    size = F.octet_length(body)
    return F.struct(F.substring(body, F.lit(1), size - 8).alias("key"), F.floor(from_big_endian(F.substring(body, size - 7, F.lit(8))) / 256).cast("long").alias("seq"))


def newest_first_key(key: str | Column, ts: str | Column) -> Column:
    """The key and its inverted timestamp, so that bytes sort new versions first."""
    return F.concat(as_column(key), big_endian(F.bitwise_not(as_column(ts).cast("long"))))


def split_newest_first(data: str | Column) -> Column:
    data = as_column(data)
    size = F.octet_length(data)
    inverted = F.conv(F.hex(F.substring(data, size - 7, F.lit(8))), 16, -10).cast("long")
    return F.struct(F.substring(data, F.lit(1), size - 8).alias("key"), F.bitwise_not(inverted).alias("ts"))


def tag_inline(value: str | Column) -> Column:
    return F.concat(F.unhex(F.lit(f"{INLINE:02X}")), as_column(value))


def tag_pointer(fid: str | Column, pos: str | Column) -> Column:
    return F.concat(F.unhex(F.lit(f"{POINTER:02X}")), big_endian(fid), big_endian(pos, 4))


def read_tagged(data: str | Column) -> Column:
    """A struct ``(tag, inline, fid, pos)``; what a tag doesn't have is null."""
    data = as_column(data)
    tag = F.conv(F.hex(F.substring(data, F.lit(1), F.lit(1))), 16, 10).cast("int")
    pointer = tag != INLINE
    return F.struct(
        tag.alias("tag"),
        F.when(~pointer, F.substring(data, F.lit(2), F.octet_length(data))).alias("inline"),
        F.when(pointer, from_big_endian(F.substring(data, F.lit(2), F.lit(8))).cast("long")).alias("fid"),
        F.when(pointer, from_big_endian(F.substring(data, F.lit(10), F.lit(4))).cast("long")).alias("pos"),
    )


def value_struct(meta: str | Column, expires_at: str | Column, value: str | Column) -> Column:
    return F.concat(big_endian(meta, 1), varint(expires_at), as_column(value))


def read_value_struct(data: str | Column) -> Column:
    data = as_column(data)
    head = read_varint(data, 2)
    return F.struct(from_big_endian(F.substring(data, F.lit(1), F.lit(1))).cast("int").alias("meta"), head["value"].alias("expires_at"), F.substring(data, head["size"] + 2, F.octet_length(data)).alias("value"))


def entry_header(meta: str | Column, key_size: str | Column, value_size: str | Column, expires_at: str | Column) -> Column:
    return F.concat(big_endian(meta, 1), varint(key_size), varint(value_size), varint(expires_at))


def estimated_size(key: str | Column, value: str | Column, threshold: int = INLINE_LIMIT + 1) -> Column:
    k, v = F.octet_length(as_column(key)), F.octet_length(as_column(value))
    return F.when(v < threshold, k + v + 1).otherwise(k + POINTER_BYTES)


def value_log_record_size(key: str | Column, value: str | Column) -> Column:
    """Checksum, two lengths, type, key and value."""
    k, v = F.octet_length(as_column(key)), F.octet_length(as_column(value))
    return (F.lit(5) + varint_length(k) + varint_length(v) + k + v).cast("long")


def wal_record_size(key: str | Column, value: str | Column) -> Column:
    return (F.lit(17) + F.octet_length(as_column(key)) + F.octet_length(as_column(value))).cast("long")


def next_power_of_2(n: str | Column) -> Column:
    n = as_column(n).cast("long")
    return F.when(n <= 1, n).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1)).cast("int")))


def file_number(name: str | Column, suffix: str) -> Column:
    """The number in ``00012.sst``; 0 for other names."""
    return F.coalesce(F.regexp_extract(as_column(name), rf"(?:^|/)([0-9]+)\.{suffix}$", 1).try_cast("long"), F.lit(0).cast("long"))


def file_name(number: str | Column, suffix: str) -> Column:
    n = as_column(number).cast("string")
    return F.concat(F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(n), F.lit(f".{suffix}"))


def expires(seconds: int, now: Column | None = None) -> Column:
    return (now if now is not None else F.unix_timestamp()) + seconds
