"""Large values kept apart from their keys: separation, offsets, dereference, collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import value_log_record_size, wal_record_size
from ..model import INLINE, INLINE_LIMIT, POINTER


def separate(entries: DataFrame, file: str = "fid") -> DataFrame:
    """Adds ``tag, inline, pos``: values of more than 15 bytes go to their file's value log.

    Positions are running sums of record sizes in flush order: key, new to old.
    """
    apart = F.octet_length("value") > INLINE_LIMIT
    size = F.when(apart, value_log_record_size("key", "value")).otherwise(0)
    w = Window.partitionBy(file).orderBy("key", F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = entries.withColumn("record", size).withColumn("end", F.sum("record").over(w))
    return t.select(*entries.columns, F.when(apart, POINTER).otherwise(INLINE).alias("tag"), F.when(~apart, F.col("value")).alias("inline"), F.when(apart, F.col("end") - F.col("record")).alias("pos"), F.col("record").alias("record_bytes"))


def tables(separated: DataFrame, file: str = "fid") -> tuple[DataFrame, DataFrame]:
    """The sorted-file entries ``(fid, key, seq, tag, inline, vfid, pos)`` and the value log ``(vfid, pos, key, value)``."""
    sst = separated.select(file, "key", "seq", "tag", "inline", F.when(F.col("tag") == POINTER, F.col(file)).alias("vfid"), "pos")
    vlog = separated.where(F.col("tag") == POINTER).select(F.col(file).alias("vfid"), "pos", "key", "value", "record_bytes")
    return sst, vlog


def dereference(sst: DataFrame, vlog: DataFrame) -> DataFrame:
    """Entries with their values; a pointer into nothing gives null.

    Only pointers are joined: inline entries have none, and would all meet at null.
    """
    keep = [c for c in sst.columns if c not in ("vfid", "pos", "tag", "inline")]
    here = sst.where(F.col("tag") == INLINE).select(*keep, F.col("inline").alias("value"))
    there = sst.where(F.col("tag") == POINTER).join(vlog.select("vfid", "pos", F.col("value").alias("stored")), ["vfid", "pos"], "left")
    return here.unionByName(there.select(*keep, F.col("stored").alias("value")))


def dangling(sst: DataFrame, vlog: DataFrame) -> DataFrame:
    return sst.where(F.col("tag") == POINTER).join(vlog, ["vfid", "pos"], "left_anti")


def wal_offsets(log: DataFrame, writer: str | None = None) -> DataFrame:
    """Adds ``size, pos``: where each entry's record starts in its writer's commit log."""
    w = Window.partitionBy(*([writer] if writer else [])).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = log.withColumn("size", wal_record_size("key", "value"))
    return t.withColumn("pos", F.sum("size").over(w) - F.col("size"))


def live_pointers(sst: DataFrame) -> DataFrame:
    """Pointers of the newest versions."""
    newest = sst.groupBy("key").agg(F.max_by(F.struct("tag", "vfid", "pos"), "seq").alias("p"))
    return newest.where(F.col("p.tag") == POINTER).select("p.vfid", "p.pos")


def garbage(sst: DataFrame, vlog: DataFrame) -> DataFrame:
    """``(vfid, records, dead, bytes, dead_bytes)`` of every value log."""
    live = live_pointers(sst).distinct().withColumn("live", F.lit(True))
    t = vlog.join(live, ["vfid", "pos"], "left").withColumn("dead", F.col("live").isNull())
    return t.groupBy("vfid").agg(F.count("*").alias("records"), F.count_if("dead").alias("dead"), F.sum("record_bytes").alias("bytes"), F.sum(F.when(F.col("dead"), F.col("record_bytes")).otherwise(0)).alias("dead_bytes"))


def collect(sst: DataFrame, vlog: DataFrame, new_file: int | Column) -> DataFrame:
    """Entries with their pointed values copied into new value logs in key order: ``(fid, key, seq, tag, pos, value)``.

    ``new_file`` is the new number, of one file or as a column of each old one.
    """
    number = F.lit(new_file) if isinstance(new_file, int) else new_file
    whole = dereference(sst, vlog).withColumn("fid", number.cast("long")).select("fid", "key", "seq", "value")
    return separate(whole).select("fid", "key", "seq", "tag", "pos", "value")
