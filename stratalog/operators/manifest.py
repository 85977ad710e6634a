"""Replaying a manifest of file edits and commit logs up to the first damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CREATE, DELETE


def committed(edits: DataFrame) -> DataFrame:
    """Adds and deletes of the groups before the first incomplete one."""
    bad = edits.where(~F.col("complete")).agg(F.min("txn").alias("bad"))
    return edits.join(F.broadcast(bad), F.col("bad").isNull() | (F.col("txn") < F.col("bad")), "left_semi").where(F.col("op").isin(CREATE, DELETE))


def replay(edits: DataFrame) -> DataFrame:
    """The files that are there: the last edit of each (level, id) is an add.  Adds of a group come before its deletes."""
    last = committed(edits).groupBy("level", "id").agg(F.max_by(F.struct("op", "size", "smallest", "largest"), F.struct("txn", "op", "pos")).alias("e"))
    return last.where(F.col("e.op") == CREATE).select("level", "id", "e.size", "e.smallest", "e.largest")


def next_file_number(edits: DataFrame, *numbers: DataFrame) -> DataFrame:
    """One more than the largest id of any edit or other file."""
    ids = committed(edits).select(F.col("id").cast("long").alias("id"))
    for n in numbers:
        ids = ids.unionByName(n.select(F.col(n.columns[0]).cast("long").alias("id")))
    return ids.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def valid_prefix(wal: DataFrame) -> DataFrame:
    """Records of each commit log before its first bad one (``ok`` false)."""
    bad = wal.where(~F.col("ok")).groupBy("fid").agg(F.min("pos").alias("bad"))
    return wal.join(bad, "fid", "left").where(F.col("bad").isNull() | (F.col("pos") < F.col("bad"))).drop("bad")


def recover(wal: DataFrame) -> DataFrame:
    """The log that valid records of all commit logs make, in the order of (fid, pos)."""
    return valid_prefix(wal).select("key", "seq", "value", "fid", "pos").orderBy("fid", "pos")
