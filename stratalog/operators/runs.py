"""Sorted runs: flushing a log into files, file statistics, merging, compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Options
from .log import latest


def payload(key: str = "key", value: str = "value") -> Column:
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def rotate(log: DataFrame, options: Options = Options(), group: str | None = None) -> DataFrame:
    """Adds ``run``: which memtable's flush an entry belongs to.

    A memtable is full once its payload exceeds the limit, so an entry goes to the run
    that the bytes before it have reached.  ``group`` numbers the runs of each writer
    by itself; without it the log is one writer's.
    """
    w = Window.partitionBy(*([group] if group else [])).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(payload()).over(w), F.lit(0))
    return log.withColumn("run", F.floor(before / (options.memtable_size + 1)).cast("long"))


def file_stats(entries: DataFrame, file: str = "fid") -> DataFrame:
    """Entries, keys, bytes and bounds of each file."""
    return entries.groupBy(file).agg(F.count("*").alias("entries"), F.countDistinct("key").alias("keys"), F.sum(payload()).alias("size"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def merge(*runs: DataFrame) -> DataFrame:
    """The newest version of every key of several runs."""
    return latest(reduce(DataFrame.unionByName, [r.select("key", "seq", "value") for r in runs]))


def compact(entries: DataFrame, inputs: DataFrame, file: str = "fid") -> DataFrame:
    """Merges the files that ``inputs`` names and leaves the rest: rows ``(fid, key, seq, value)``, merged ones with null fid."""
    chosen = inputs.select(file).distinct()
    merged = latest(entries.join(chosen, file, "left_semi")).withColumn(file, F.lit(None).cast("long"))
    rest = entries.join(chosen, file, "left_anti").select(file, "key", "seq", "value")
    return rest.unionByName(merged.select(file, "key", "seq", "value"))


def floor_block(blocks: DataFrame, probes: DataFrame, file: str = "fid") -> DataFrame:
    """For each ``(fid, key)``: the first block whose base is the key, else the last block with a smaller base; null before the first.

    Blocks and probes of a file are sorted together and the last base carried along.
    """
    bases = blocks.groupBy(file, F.col("base").alias("key")).agg(F.min("block").alias("first"), F.max("block").alias("last")).withColumn("kind", F.lit(0))
    asked = probes.select(file, "key").distinct().withColumn("kind", F.lit(1))
    rows = bases.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(file).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("kind") == 0, F.struct("key", "first", "last")), ignorenulls=True).over(w)
    found = rows.withColumn("at", at).where("kind = 1")
    return found.select(file, "key", F.when(F.col("at.key") == F.col("key"), F.col("at.first")).otherwise(F.col("at.last")).alias("block"))
