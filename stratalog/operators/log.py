"""Reads and writes of a versioned log ``(key, seq, value)``.

The latest version of a key is one combinable aggregate, so a log shuffles one row a
key and task, and a hot key never meets in one place.  A null value is a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import BYTES, sort_columns, version_columns
from ..model import EmptyKey, StoreError


def latest(log: DataFrame) -> DataFrame:
    """The newest version of every key."""
    return log.groupBy("key").agg(F.max_by(F.struct("seq", "value"), "seq").alias("v")).select("key", "v.seq", "v.value")


def get(log: DataFrame, key: str) -> DataFrame:
    """A key's latest version, or no row.  The filter reaches the scan."""
    if not key:
        raise EmptyKey(key)
    return latest(log.where(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each wanted key; a miss has null seq and value."""
    wanted = keys.select("key").distinct()
    return wanted.join(latest(log.join(wanted, "key", "left_semi")), "key", "left")


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """The latest view as of a sequence number, itself included."""
    return latest(log.where(F.col("seq") <= seq))


def as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe ``(key, at)`` the newest version with seq <= at, misses as nulls.

    Probes and versions of a key are sorted together once and the last version carried
    along; no pair of a probe and an older version is made.
    """
    versions = log.select("key", F.col("seq").alias("at"), F.lit(0).alias("kind"), F.struct("seq", "value").alias("v"))
    asked = probes.select("key", "at").distinct().withColumn("kind", F.lit(1)).withColumn("v", F.lit(None).cast(versions.schema["v"].dataType))
    w = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = versions.unionByName(asked).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("kind = 1")
    return found.select("key", "at", "v.seq", "v.value")


def history(log: DataFrame, ordering: str = BYTES) -> DataFrame:
    """All versions in key order, new to old, with their rank within the key (1: newest)."""
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return log.withColumn("age", F.row_number().over(w)).orderBy(*version_columns("key", "seq", ordering))


def version_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("versions"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def shadowed(log: DataFrame) -> DataFrame:
    """Versions that a newer one hides."""
    newest = log.groupBy("key").agg(F.max("seq").alias("newest"))
    return log.join(newest, "key").where(F.col("seq") < F.col("newest")).select("key", "seq", "value")


def in_range(key: str | Column, low: str | None, high: str | None, ordering: str = BYTES) -> Column:
    """low <= key <= high in an order; None is open."""
    out = F.lit(True)
    for bound, lower in ((low, True), (high, False)):
        if bound is None:
            continue
        mine = F.struct(*order_values(key, ordering))
        edge = F.struct(*order_values(F.lit(bound), ordering))
        out = out & ((mine >= edge) if lower else (mine <= edge))
    return out


def order_values(key: str | Column, ordering: str) -> list[Column]:
    from ..functions.ordering import INTEGER, as_column, folded

    key = as_column(key)
    if ordering == INTEGER:
        return [F.when(key.rlike("^[0-9]{1,18}$"), key.try_cast("long")).otherwise(folded(key)), key]
    return [key]


def scan(log: DataFrame, low: str | None = None, high: str | None = None, ordering: str = BYTES) -> DataFrame:
    """The latest view of a key range, in order."""
    if ordering == BYTES:  # plain comparisons reach the scan
        keep = (F.lit(True) if low is None else F.col("key") >= low) & (F.lit(True) if high is None else F.col("key") <= high)
    else:
        keep = in_range("key", low, high, ordering)
    return latest(log.where(keep)).orderBy(*sort_columns("key", ordering))


def lower_bound(log: DataFrame, bound: str, ordering: str = BYTES) -> DataFrame:
    """The newest version of the first key that isn't below ``bound``, or no row."""
    keep = F.col("key") >= bound if ordering == BYTES else in_range("key", bound, None, ordering)
    return log.where(keep).orderBy(*version_columns("key", "seq", ordering)).limit(1)


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, so that every use sees the same partitions.

    The folder is that of ``spark.checkpoint.dir``; only a local session may do without.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir("/tmp/checkpoints")
    return df.checkpoint()


def by_range(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` dealt by ranges of an order and sorted, with the number of its partition and its place in it: pinned."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return pinned(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the row numbers 0, 1, 2, ... of an order, without one task that sees all rows.

    Rows are numbered within ranges; the window is over one count for each partition.
    """
    rows = by_range(df, order)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "part").withColumn("_number", F.col("start") + F.col("place")).select(*df.columns, F.col("_number").alias(name))


def counted(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Adds how many rows before each have ``flag``, in the order by which :func:`by_range` dealt them.

    Rows are counted within ranges; the window over all is over one count for each partition.
    """
    w = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count_if(flag).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "part").withColumn(name, F.col("_start") + F.count_if(flag).over(w)).drop("_start")


def lower_bounds(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """For each ``bound`` the first key not below it, in byte order, misses as nulls.

    Keys and bounds are sorted together by range; a bound's answer is the next key in
    its partition, or the least key of the next partition that has one, from a table of
    one row a partition.
    """
    keys = log.select(F.col("key").alias("k")).distinct().withColumn("is_key", F.lit(True))
    asked = bounds.select(F.col("bound").alias("k")).distinct().withColumn("is_key", F.lit(False))
    both = by_range(keys.unionByName(asked), [F.col("k")])
    w = Window.partitionBy("part").orderBy(F.col("k").desc(), F.col("is_key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("found", F.last(F.when(F.col("is_key"), F.col("k")), ignorenulls=True).over(w)).where(~F.col("is_key"))
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = both.groupBy("part").agg(F.min(F.when(F.col("is_key"), F.col("k"))).alias("head")).select("part", F.last("head", ignorenulls=True).over(later).alias("next"))
    return marked.join(F.broadcast(heads), "part").select(F.col("k").alias("bound"), F.coalesce("found", "next").alias("key"))


def require_keys(batch: DataFrame) -> DataFrame:
    """The batch; reading a row without a key raises."""
    bad = F.col("key").isNull() | (F.octet_length("key") == 0)
    return batch.withColumn("key", F.when(bad, F.raise_error(F.lit("empty key"))).otherwise(F.col("key")))


def valid_keys(batch: DataFrame) -> DataFrame:
    return batch.where(F.octet_length("key") > 0)


def upsert(log: DataFrame, batch: DataFrame, order: list[Column], base: int | None = None) -> DataFrame:
    """The log with a batch appended; its rows get the numbers after ``base`` in the given order.

    Rows are numbered by ranges of the order (:func:`numbered`), however large the batch is.
    """
    if base is None:
        base = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    rows = numbered(batch, order, "_seq").select("key", (F.lit(base + 1) + F.col("_seq")).alias("seq"), "value")
    return log.select("key", "seq", "value").unionByName(rows)
