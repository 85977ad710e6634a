"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents become sequences of up to ``length`` ids.  Sequences are numbered without
gaps in the order of the input's partitions; a keyed Feistel permutation of that range
(cycle-walking back into it) gives each its slot.  Shard k holds the slots from
k * per_shard on, in order, as records of one size, so slot s of a run is read by one
seek and a run resumes anywhere.

A record is doc_id (int64, the least one for null), number within the document
(uint32), ids used (uint32), ``length`` ids little-endian in as few bytes as the
vocabulary needs, zero-padded, and a line feed.

Null and empty texts have no sequence.  Equal rows have sequences of their own.

Texts are tokenized once: the sequences are written to a staging table with their
partition and place in it, and what is counted, numbered and dealt comes from that
table alone, so a run that loses executors or reads a source that changes still has one
numbering.  Counts and places must agree, and so must the shards' bytes, or the run
fails.  Only unpadded records are shuffled, a ``rounds``-th of the shards at a time, so
that the shuffle's files take a part of the room.  The driver holds one number for each
partition.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, mix64, mix_int, released_shuffles

HEAD = "<qII"
HEAD_SIZE = struct.calcsize(HEAD)
NO_ID = -(1 << 63)
ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0..n-1 for each key."""

    n: int
    key: int

    @property
    def half(self) -> int:
        return max(1, -(-max(self.n - 1, 1).bit_length() // 2))

    def rounds(self, x: np.ndarray, order: range, forward: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for r in order:
            key = np.uint64(mix_int(self.key * 64 + r))
            if forward:
                left, right = right, left ^ (mix64(right ^ key) & mask)
            else:
                left, right = right ^ (mix64(left ^ key) & mask), left
        return (left << half) | right

    def walk(self, x: np.ndarray, order: range, forward: bool) -> np.ndarray:
        x = self.rounds(np.asarray(x, dtype=np.uint64), order, forward)
        while (out := x >= self.n).any():
            x[out] = self.rounds(x[out], order, forward)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self.walk(index, range(ROUNDS), True)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self.walk(slot, range(ROUNDS - 1, -1, -1), False)


@dataclass(frozen=True)
class Layout:
    path: str
    sequences: int
    per_shard: int
    length: int
    width: int
    key: int

    @property
    def stride(self) -> int:
        return HEAD_SIZE + self.length * self.width + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)


def byte_ids(texts: list[bytes]) -> list[bytes]:
    """UTF-8 bytes are the ids of a vocabulary of 256."""
    return texts


# Fixed value: the pattern that parts text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def ranked(ranks: bytes, pattern: str):
    """The tokenizer of a rank file's content, made once in each worker."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def rank_ids(ranks: bytes, pattern: str = PATTERN) -> Callable[[list[bytes]], list[bytes]]:
    """Ids of a byte-level BPE rank file, two bytes each."""

    def pack(texts: list[bytes]) -> list[bytes]:
        encode = ranked(ranks, pattern).encode_ordinary
        return [np.array(encode(t.decode("utf-8", "replace")), dtype="<u2").tobytes() for t in texts]

    return pack


def staged(docs: DataFrame, pack: Callable[[list[bytes]], list[bytes]], width: int, stride: int) -> DataFrame:
    """``(part, place, record)``: every sequence, its number in its partition, its record without padding."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                texts = [x.as_py() or b"" for x in some.column("text").cast(pa.large_binary())]
                out = []
                for doc, ids in zip(some.column("doc_id").to_pylist(), pack(texts)):
                    for k, at in enumerate(range(0, len(ids), stride)):
                        body = ids[at : at + stride]
                        out.append(struct.pack(HEAD, NO_ID if doc is None else doc, k, len(body) // width) + body)
                places = np.arange(place, place + len(out))
                place += len(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), part)), pa.array(places), pa.array(out, type=pa.binary())], names=["part", "place", "record"])

    return source.mapInArrow(run, "part long, place long, record binary")


def first_numbers(rows: DataFrame) -> tuple[dict[int, int], int]:
    """The number of each partition's first sequence, and of all of them; fails unless every partition's places are 0, 1, 2, ..."""
    found = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.sum("place").alias("total")).collect()
    base, total = {}, 0
    for r in sorted(found, key=lambda r: r["part"]):
        if (r["low"], r["high"], 2 * r["total"]) != (0, r["n"] - 1, r["n"] * (r["n"] - 1)):
            raise ValueError(f"the sequences of partition {r['part']} aren't numbered without gaps")
        base[r["part"]] = total
        total += r["n"]
    return base, total


def write(docs: DataFrame, path: str, pack: Callable[[list[bytes]], list[bytes]] = byte_ids, width: int = 1, length: int = 1024, per_shard: int = 8192, key: int = 20240229, rounds: int = 2) -> Layout:
    """Writes the shards of ``(doc_id, text)`` and, last, a manifest; a path without one is unfinished."""
    spark = docs.sparkSession
    staging = f"{path}/staging"
    rows = staged(docs, pack, width, length * width)
    rows.write.option("compression", "zstd").parquet(staging)
    rows = spark.read.schema(rows.schema).parquet(staging)
    base, total = first_numbers(rows)
    layout = Layout(path, total, per_shard, length, width, key)
    if total:
        sent = spark.sparkContext.broadcast(base)
        order = Permutation(total, key)

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = np.array([sent.value[p] for p in batch.column("part").to_pylist()], dtype=np.int64)
                slots = order.slot(first + batch.column("place").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array((slots // per_shard).astype(np.int32)), pa.array(slots), batch.column("record")], names=["shard", "slot", "record"])

        dealt = rows.mapInArrow(numbered, "shard int, slot long, record binary")
        # Spark's text writer takes strings only; the bytes stay as they are.
        full = F.rpad("record", layout.stride - 1, F.lit(b"\0")).cast("string").alias("record")
        edges = sorted({layout.shards * r // rounds for r in range(rounds + 1)})
        for low, high in zip(edges, edges[1:]):
            part = dealt.where((F.col("shard") >= low) & (F.col("shard") < high)).withColumn("at", F.col("shard") - low)
            with released_shuffles(spark):
                part.repartitionById(high - low, "at").sortWithinPartitions("slot").select(full).write.option("lineSep", "\n").text(shard_path(path, low))
        size = files(spark, layout).agg(F.sum("length")).first()[0]
        if size != total * layout.stride:
            raise ValueError(f"the shards have {size} bytes instead of {total * layout.stride}")
    delete(spark, staging)
    manifest = json.dumps(asdict(layout))
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return layout


def shard_path(path: str, first: int) -> str:
    """The folder of the shards of one round, named after the first one's number."""
    return f"{path}/shards/first={first}"


def files(spark: SparkSession, layout: Layout) -> DataFrame:
    """``(shard, length, content)`` of the shards' files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{layout.path}/shards")
    first, own = (F.regexp_extract("path", p, 1).cast("int") for p in (r"/first=(\d+)/", r"part-(\d+)"))
    return found.select((first + own).alias("shard"), "length", "content")


def open_layout(spark: SparkSession, path: str) -> Layout:
    return Layout(**json.loads(spark.read.text(f"{path}/manifest").first()[0]))


def read(spark: SparkSession, layout: Layout, from_slot: int = 0) -> DataFrame:
    """``(slot, shard, doc_id, seq_no, n_tokens, ids)`` from a slot on; earlier shards aren't opened.  ``ids`` are their bytes."""
    schema = "slot long, shard int, doc_id long, seq_no long, n_tokens long, ids binary"
    if not layout.sequences:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                data = memoryview(content.as_py())
                if len(data) % layout.stride:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                low = max(0, from_slot - shard * layout.per_shard)
                for start in range(low, len(data) // layout.stride, 2048):
                    rows = []
                    for i in range(start, min(start + 2048, len(data) // layout.stride)):
                        record = data[i * layout.stride : (i + 1) * layout.stride]
                        doc, k, n = struct.unpack_from(HEAD, record)
                        rows.append((shard * layout.per_shard + i, shard, None if doc == NO_ID else doc, k, n, bytes(record[HEAD_SIZE : HEAD_SIZE + n * layout.width])))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["slot", "shard", "doc_id", "seq_no", "n_tokens", "ids"])

    wanted = files(spark, layout).where(F.col("shard") >= from_slot // layout.per_shard)
    return wanted.select("shard", "content").mapInArrow(run, schema)
