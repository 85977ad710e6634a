"""Bloom filters and count-min sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .hashes import hash32_many

# Fixed values of the filter: ln 2 as rounded for the number of probes, and limits.
LN2 = 0.69314718056
PROBES_PER_BIT, MOST_PROBES, LEAST_BITS = 0.69, 30, 64
ROWS, TOP = 4, 15


def bloom_bits_per_key(false_positive: str | Column) -> Column:
    p = F.col(false_positive) if isinstance(false_positive, str) else false_positive
    return F.ceil(-F.log(p) / F.lit(LN2**2)).cast("int")


def probes(bits_per_key: int) -> int:
    return min(max(int(max(bits_per_key, 0) * PROBES_PER_BIT), 1), MOST_PROBES)


def bit_places(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """len(hashes) x k places; each probe adds the hash rotated by 17 bits."""
    h = hashes.astype(np.uint32)
    step = (h >> np.uint32(17)) | (h << np.uint32(15))
    return (h[:, None] + step[:, None] * np.arange(k, dtype=np.uint32)[None, :]) % np.uint32(bits)


def build_filter(hashes: np.ndarray, bits_per_key: int) -> bytes:
    k = probes(bits_per_key)
    bits = -(-max(len(hashes) * max(bits_per_key, 0), LEAST_BITS) // 8) * 8
    flags = np.zeros(bits, dtype=np.uint8)
    flags[bit_places(hashes, k, bits).ravel()] = 1
    return np.packbits(flags, bitorder="little").tobytes() + bytes([k])


def may_contain(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    if len(filter_) < 2:
        return np.zeros(len(hashes), dtype=bool)
    k = filter_[-1]
    if k > MOST_PROBES:
        return np.ones(len(hashes), dtype=bool)
    flags = np.unpackbits(np.frombuffer(filter_[:-1], dtype=np.uint8), bitorder="little")
    return flags[bit_places(hashes, k, len(flags))].all(axis=1)


def bloom_filters(entries: DataFrame, group: str, key: str, bits_per_key: int) -> DataFrame:
    """``(group, filter)``: one filter for each group's distinct keys.

    A group is one sorted file's keys, whose size a store bounds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        filter_ = build_filter(hash32_many([k.encode() for k in pdf[key]]), bits_per_key)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "filter": [filter_]})

    kind = entries.schema[group].dataType.simpleString()
    return entries.select(group, key).where(F.col(key).isNotNull()).distinct().groupBy(group).applyInPandas(run, f"{group} {kind}, filter binary")


def probe(pairs: DataFrame, key: str, filter_: str) -> DataFrame:
    """Adds ``may_contain``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            hashes = hash32_many([k.encode() for k in pdf[key]])
            yield pdf.assign(may_contain=[bool(may_contain(bytes(f), hashes[i : i + 1])[0]) for i, f in enumerate(pdf[filter_])])

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("may_contain", BooleanType())]))


class CountMin:
    """Four rows of saturating 4-bit counters."""

    def __init__(self, counters: int, seed: int = 1):
        if counters < 1:
            raise ValueError("a sketch needs counters")
        self.mask = (1 << (counters - 1).bit_length()) - 1
        rng = np.random.default_rng(seed)
        self.seeds = [int(x) for x in rng.integers(0, 1 << 63, ROWS)]
        self.rows = [[0] * (self.mask + 1) for _ in range(ROWS)]

    def increment(self, hash_: int) -> None:
        for row, seed in zip(self.rows, self.seeds):
            i = (hash_ ^ seed) & self.mask
            row[i] = min(row[i] + 1, TOP)

    def estimate(self, hash_: int) -> int:
        return min(row[(hash_ ^ seed) & self.mask] for row, seed in zip(self.rows, self.seeds))

    def halve(self) -> None:
        self.rows = [[v >> 1 for v in row] for row in self.rows]

    def clear(self) -> None:
        self.rows = [[0] * len(row) for row in self.rows]


def count_min(accesses: DataFrame, key: str, counters: int, seed: int = 1) -> DataFrame:
    """``(key, estimate)`` of all accesses, without a sketch in one place.

    Counters are sums by (row, place), combined before the shuffle, saturating at 15 as
    single increments would; a key's estimate is the least of its four.
    """
    mask = (1 << (counters - 1).bit_length()) - 1
    seeds = CountMin(counters, seed).seeds
    places = F.array(*[F.struct(F.lit(r).alias("row"), F.xxhash64(key).bitwiseXOR(F.lit(s)).bitwiseAND(mask).alias("place")) for r, s in enumerate(seeds)])
    keys = accesses.groupBy(key).agg(F.count("*").alias("n")).select(key, "n", F.explode(places).alias("at")).select(key, "n", "at.*")
    cells = keys.groupBy("row", "place").agg(F.least(F.sum("n"), F.lit(TOP)).alias("cell"))
    return keys.join(cells, ["row", "place"]).groupBy(key).agg(F.min("cell").alias("estimate"))
