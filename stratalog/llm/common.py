"""What the operators share: scratch tables, Arrow buffers, 64-bit mixing, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables go if the session names no shared folder (tests on one machine).
LOCAL_SCRATCH = "/tmp/checkpoints"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


class Scratch:
    """Tables in the shared folder that ``spark.checkpoint.dir`` names.

    A saved table cuts lineage: a lost executor costs a rerun of the stage that
    reads it, not of all that led to it.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            base = LOCAL_SCRATCH
        self.root = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with released_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            delete(self.spark, self.path(name))


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written within frees its shuffle files when it is done, by Spark's own setting, on the executors too."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Bits of the map that :func:`marked` broadcasts: 8 MB at most, whatever there is to mark.
MAP_BITS = 1 << 26


def marked(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``df`` with ``_maybe``: false where ``key`` is surely not among the wanted keys.

    The wanted keys' hashes are marked in a map of a fixed number of bits, which is all
    that is broadcast, so that what isn't wanted needs no shuffle.  The more keys are
    wanted, the more others pass; a join with them decides.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(MAP_BITS)) + 1
    spots = wanted.select(place(wanted_key).alias("_spot"))
    bits = spots.groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    at = df.withColumn("_spot", place(key))
    at = at.withColumn("_at", F.bitmap_bit_position("_spot").cast("int")).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    found = at.join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.expr("shiftright(_byte, _at % 8) & 1") == 1, F.lit(False))
    return found.withColumn("_byte", byte).withColumn("_maybe", bit).select(*df.columns, "_maybe")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (two xor-shift multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & MASK], dtype=np.uint64))[0])


def byte_weights(seed: int) -> np.ndarray:
    """256 odd pseudo-random 64-bit numbers."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(mix_int(seed) | 1)) | np.uint64(1)


class Powers:
    """base**i and base**-i modulo 2**64, extended when longer ones are asked for."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            steps = np.full(n, self.BASE, dtype=np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = pow(self.BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def as_table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of undirected ``(a, b)`` edges: rows ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps; each is a combinable minimum per
    node and a join, and every round is written to the scratch folder.  Nodes
    without edges don't appear; no edges give no rows.
    """
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    before, k = None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        k += 1
        old, edges = edges, scratch.save(small.where("a <> b").distinct(), f"{tag}-{k}")
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        if k > 1:
            scratch.drop(f"{tag}-{k - 1}")
        del old
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
