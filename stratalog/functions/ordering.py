"""Key orders as lists of sort columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES, INTEGER = "bytes", "integer"


def as_column(key: str | Column) -> Column:
    return F.col(key) if isinstance(key, str) else key


def folded(key: str | Column) -> Column:
    """The 64-bit value that folding ``v * 10 + byte - 48`` over the bytes gives, wrapping around."""
    text = F.hex(F.encode(as_column(key), "UTF-8"))
    bytes_ = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), lambda i: F.conv(F.substring(text, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("decimal(38,0)"))).otherwise(F.array().cast("array<decimal(38,0)>"))
    span = F.lit(Decimal(1 << 64)).cast("decimal(38,0)")
    wrapped = F.aggregate(bytes_, F.lit(0).cast("decimal(38,0)"), lambda v, b: F.pmod(v * F.lit(10).cast("decimal(3,0)") + b - F.lit(48).cast("decimal(3,0)"), span).cast("decimal(38,0)"))
    return F.when(wrapped >= F.lit(Decimal(1 << 63)).cast("decimal(38,0)"), wrapped - span).otherwise(wrapped).cast("long")


def sort_columns(key: str | Column, ordering: str = BYTES) -> list[Column]:
    """Columns that sort keys: unsigned bytes, or as integers with the bytes to break ties."""
    key = as_column(key)
    if ordering == BYTES:
        return [key.asc()]
    if ordering == INTEGER:
        # Eighteen digits can't wrap, and a cast is far cheaper than a fold.
        plain = key.rlike("^[0-9]{1,18}$")
        return [F.when(plain, key.try_cast("long")).otherwise(folded(key)).asc(), key.asc()]
    raise ValueError(f"unknown order {ordering}")


def version_columns(key: str | Column, seq: str | Column = "seq", ordering: str = BYTES) -> list[Column]:
    """Keys in order, and the versions of a key from new to old."""
    return [*sort_columns(key, ordering), as_column(seq).desc()]
