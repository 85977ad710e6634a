"""Physical layout of sorted files: blocks, prefix overlap, indexes.

Cutting blocks is a fold with resets over one file's entries, whose number a store
bounds; files are laid out in parallel.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the block format: header and offset bytes of an entry, trailer of a block, of a file.
ENTRY_HEAD, SEQ_BYTES, OFFSET_BYTES, BLOCK_TAIL, FILE_TAIL = 4, 8, 4, 16, 16
ESTIMATE_HEAD = 6


def common_prefix(a: str | Column, b: str | Column) -> Column:
    """Bytes that two keys have in common at the start."""
    x, y = (F.hex(F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")) for c in (a, b))
    n = F.least(F.length(x), F.length(y))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (i <= n) & (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))), i).otherwise(s))
    return F.floor(same / 2).cast("int")


def pack(keys: list[bytes], values: list[int], block_size: int) -> list[tuple[int, int, int, int]]:
    """``(block, overlap, offset in block, bytes)`` of entries in file order; values are tagged sizes.

    A new entry cuts the block if what it holds, the entry's estimate, all offsets and
    the trailer exceed the limit.
    """
    out, block, end, count, base = [], -1, 0, 0, b""
    for key, size in zip(keys, values):
        if count == 0 or end + ESTIMATE_HEAD + len(key) + size + OFFSET_BYTES * (count + 1) + BLOCK_TAIL > block_size:
            block, end, count, base = block + 1, 0, 0, key
            overlap = 0
        else:
            overlap = len(os.path.commonprefix([base, key]))
        took = ENTRY_HEAD + len(key) - overlap + SEQ_BYTES + size
        out.append((block, overlap, end, took))
        end, count = end + took, count + 1
    return out


def layout(entries: DataFrame, block_size: int = 1024) -> DataFrame:
    """``(fid, key, seq, block, overlap, offset, bytes)`` of ``(fid, key, seq, tagged_bytes)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(raw=[k.encode() for k in pdf["key"]]).sort_values(["raw", "seq"], ascending=[True, False])
        made = pd.DataFrame(pack(pdf["raw"].tolist(), pdf["tagged_bytes"].tolist(), block_size), columns=["block", "overlap", "offset", "bytes"])
        return pd.concat([pdf[["fid", "key", "seq"]].reset_index(drop=True), made], axis=1)

    return entries.select("fid", "key", "seq", "tagged_bytes").groupBy("fid").applyInPandas(run, "fid long, key string, seq long, block long, overlap long, offset long, bytes long")


def block_index(rows: DataFrame) -> DataFrame:
    """``(fid, block, base, entries, bytes, offset)`` with trailers; ``offset`` is where a block starts in its file."""
    t = rows.groupBy("fid", "block").agg(F.min_by("key", "offset").alias("base"), F.count("*").alias("entries"), F.sum("bytes").alias("used"))
    t = t.select("fid", "block", "base", "entries", (F.col("used") + OFFSET_BYTES * F.col("entries") + BLOCK_TAIL).alias("bytes"))
    return t.withColumn("offset", F.sum("bytes").over(Window.partitionBy("fid").orderBy("block")) - F.col("bytes"))


def data_bytes(index: DataFrame) -> DataFrame:
    """``(fid, blocks, entries, bytes)`` of whole files, their trailer included."""
    return index.groupBy("fid").agg(F.count("*").alias("blocks"), F.sum("entries").alias("entries"), (F.sum("bytes") + FILE_TAIL).alias("bytes"))
