"""Planning over file metadata ``(level, id, size, smallest, largest)``.

Bounds compare as bytes unless ``low`` and ``high`` name columns that compare as the
keys' order does.  File tables are a store's metadata: small beside its data, but no
query here pairs files of different levels except those that overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEEPEST_FLUSH, LEVEL0_TRIGGER, LEVEL1_BYTES, LEVEL_GROWTH, NORMAL
from .log import by_range, counted, pinned

#: Most keys of a group that is given its files at once.
GROUP = 4096
#: File ids that are kept and joined in one row.
BLOCK = 1024


def level_scores(files: DataFrame, levels: int) -> DataFrame:
    """``(level, files, bytes, score)`` of all levels: files over a trigger at level 0, bytes over a growing limit below."""
    every = files.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    have = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    limit = F.lit(float(LEVEL1_BYTES)) * F.pow(F.lit(float(LEVEL_GROWTH)), F.col("level") - 1)
    t = every.join(have, "level", "left").select("level", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return t.withColumn("score", F.when(F.col("level") == 0, F.col("files") / F.lit(float(LEVEL0_TRIGGER))).otherwise(F.col("bytes") / limit))


def pick_level(files: DataFrame, levels: int) -> DataFrame:
    """One row ``(level, best)``: what to compact.

    The highest score, ties to the lowest level.  Below 0.6, the last level if it is
    over 0.5, else level 0 if it has more than half the trigger.
    """
    s = level_scores(files, levels)
    top = s.agg(
        F.max("score").alias("best"),
        F.min_by("level", F.struct(-F.col("score"), "level")).alias("arg"),
        F.max(F.when(F.col("level") == levels - 1, F.col("score"))).alias("deepest"),
        F.max(F.when(F.col("level") == 0, F.col("files"))).alias("zero"),
    )
    arg = F.when(F.col("best") > 0, F.col("arg")).otherwise(0)
    idle = F.when(F.col("deepest") > 0.5, levels - 1).when(F.col("zero") > LEVEL0_TRIGGER // 2, 0).otherwise(arg)
    return top.select(F.when(F.col("best") < 0.6, idle).otherwise(arg).cast("int").alias("level"), "best")


def overlaps(files: DataFrame, low: str = "smallest", high: str = "largest") -> DataFrame:
    """Pairs ``(level, a, b)`` of a level's files whose closed key ranges meet, a < b.

    Of two ranges that meet, the one that starts later starts within the other.  With a
    level's files numbered by their first bounds, a file so meets a run of numbers: those
    after its own, up to the last that starts by its end.  Ids are kept in blocks of
    ``BLOCK`` numbers, and a file is joined with the blocks of its run.  Each pair is made
    once, after the last shuffle; blocks are dealt to a fixed number of tasks, as their
    bytes say nothing of the pairs.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = pinned(files.select("level", "id", F.col(low).alias("low"), F.col(high).alias("high")).where("low is not null and high is not null").distinct())
    # A first bound comes before an equal last one: closed ranges meet there.
    bounds = [known.withColumn("at", F.col(c)).withColumn("kind", F.lit(kind)) for kind, c in enumerate(("low", "high"))]
    placed = counted(by_range(bounds[0].unionByName(bounds[1]), [F.col(c) for c in ("level", "at", "kind", "id", "high")]), F.col("kind") == 0, "before")
    number, end = F.max(F.when(F.col("kind") == 0, F.col("before"))), F.max(F.when(F.col("kind") == 1, F.col("before")))
    run = placed.groupBy("level", "id", "low", "high").agg(number.alias("number"), (end - 1).alias("last")).where("number < last").select("level", "id", (F.col("number") + 1).alias("first"), "last")
    run = run.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK)))).repartition(tasks, "block")
    block = F.floor(F.col("before") / BLOCK).alias("block")
    blocks = placed.where("kind = 0").groupBy(block).agg(F.sort_array(F.collect_list(F.struct("before", "id"))).alias("held")).select("block", F.col("held.id").alias("ids"), F.col("held")[0]["before"].alias("from"))
    start = F.greatest("first", "from")
    length = F.least(F.col("last"), F.col("from") + F.size("ids") - 1) - start + 1
    met = run.join(blocks, "block").select("level", "id", F.explode(F.slice("ids", (start - F.col("from") + 1).cast("int"), length.cast("int"))).alias("other")).where("id <> other")
    return met.select("level", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def candidate_files(files: DataFrame, keys: DataFrame, low: str = "smallest", high: str = "largest") -> DataFrame:
    """``(key, level, id, rank)``: files whose range holds the key, in the order a lookup tries them.

    Keys and file bounds are sorted together by range.  Keys with no bound between them
    make a group, of ``GROUP`` keys at most; a file holds all groups between its bounds,
    and the keys of a group are held by the same files in the same order.  So files are
    ranked once a group, and pairs are made by the last join, which nothing shuffles.
    Both sides of that join are dealt to a fixed number of tasks: their bytes are few,
    and say nothing of the pairs.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = pinned(files)
    # A first bound comes before an equal key, a last bound after it.
    lows, highs = (files.where(F.col(c).isNotNull()).select(F.col(c).alias("k")).distinct().withColumn("kind", F.lit(kind)) for c, kind in ((low, 0), (high, 2)))
    asked = keys.where("key is not null").select(F.col("key").alias("k")).distinct().withColumn("kind", F.lit(1))
    both = by_range(lows.unionByName(highs).unionByName(asked), [F.col("k"), F.col("kind")])
    previous = F.lag("kind").over(Window.partitionBy("part").orderBy("place"))
    opens = (F.col("kind") == 1) & ((F.col("place") % GROUP == 0) | (previous != 1))
    placed = counted(both.withColumn("opens", F.coalesce(opens, F.lit(False))), F.col("opens"), "before")
    first = placed.where("kind = 0").select(F.col("k").alias("_low"), F.col("before").alias("first"))
    last = placed.where("kind = 2").select(F.col("k").alias("_high"), (F.col("before") - 1).alias("last"))
    held = files.join(first, F.col(low) == F.col("_low")).join(last, F.col(high) == F.col("_high")).where("first <= last")
    held = held.select("level", "id", F.col(low).alias("low"), F.explode(F.sequence("first", "last")).alias("group")).repartition(tasks, "group")
    order = Window.partitionBy("group").orderBy("level", F.when(F.col("level") == 0, -F.col("id")).otherwise(F.lit(0)), "low", "id")
    ranked = held.select("group", "level", "id", F.row_number().over(order).alias("rank"))
    grouped = placed.where("kind = 1").select(F.col("k").alias("key"), (F.col("before") + F.col("opens").cast("int") - 1).alias("group")).repartition(tasks, "group")
    return grouped.join(ranked, "group").select("key", "level", "id", "rank")


def flush_level(files: DataFrame, ranges: DataFrame, levels: int, low: str = "smallest", high: str = "largest") -> DataFrame:
    """``(rid, level)`` for each new file's range ``(rid, low, high)``.

    Level 0 if it meets a file there; else as deep as level 2 while no level on the way
    is met.  Below level 0 only the first file that ends at or after the range's start
    counts, and an end that equals its start doesn't meet it.
    """
    ends = files.where(F.col("level") <= DEEPEST_FLUSH).select("level", F.col(high).alias("at"), F.col(low).alias("start"), F.lit(0).alias("kind"))
    r = ranges.select("rid", F.col("low").alias("rl"), F.col("high").alias("rh"))
    asked = r.select("rid", "rh", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST_FLUSH))).alias("level"), F.col("rl").alias("at"), F.lit(1).alias("kind"))
    # From the last end back: the least start so far is that of all files that end at or after a range's start.
    w = Window.partitionBy("level").orderBy(F.col("at").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    first = ends.unionByName(asked, allowMissingColumns=True).withColumn("first", F.min("start").over(w)).where("kind = 1")
    met = first.where(F.when(F.col("level") == 0, F.col("rh") >= F.col("first")).otherwise(F.col("rh") > F.col("first"))).select("rid", "level")
    deepest = min(DEEPEST_FLUSH, max(levels - 2, 0))
    stop = met.groupBy("rid").agg(F.min("level").alias("met"))
    return r.join(stop, "rid", "left").select("rid", F.when(F.col("met").isNull(), deepest).otherwise(F.greatest(F.least(F.col("met") - 1, F.lit(deepest)), F.lit(0))).cast("int").alias("level"))


def normal(files: DataFrame, states: DataFrame) -> DataFrame:
    """Files whose last set state is normal; one without a state isn't."""
    last = states.groupBy("id").agg(F.max_by("state", "at").alias("state")).where(F.col("state") == NORMAL)
    return files.join(last, "id", "left_semi")


def inputs_level0(files: DataFrame, states: DataFrame, low: str = "smallest", high: str = "largest") -> DataFrame:
    """``(id, role)``: all normal files of level 0, and those of level 1 that meet their envelope; none if there is nothing to merge."""
    base = normal(files.where("level = 0"), states)
    span = base.agg(F.min(low).alias("l"), F.max(high).alias("h"))
    target = files.where("level = 1").join(F.broadcast(span), (F.col(high) >= F.col("l")) & (F.col(low) <= F.col("h")), "left_semi")
    return unless_trivial(base.select("id", F.lit("base").alias("role")).unionByName(target.select("id", F.lit("target").alias("role"))))


def inputs_last_level(files: DataFrame, states: DataFrame, levels: int) -> DataFrame:
    return unless_trivial(normal(files.where(F.col("level") == levels - 1), states).select("id", F.lit("target").alias("role")))


def inputs_middle(files: DataFrame, states: DataFrame, level: int, pending: tuple[int, int, str, str] | None, low: str = "smallest", high: str = "largest") -> DataFrame:
    """Inputs at a level between, which only a pending garbage collection ``(level, id, smallest, largest)`` asks for.

    At this level: the first normal file that isn't the pending one.  At the next: the
    first file that doesn't meet it.  With the next level's files that meet the choice.
    """
    own = files.where(F.col("level") == level)
    if pending is None or pending[0] not in (level, level + 1):
        return own.where("false").select("id", F.lit("base").alias("role"))
    if pending[0] == level:
        own = normal(own, states).where(F.col("id") != pending[1])
    else:
        own = own.where((F.lit(pending[2]) > F.col(high)) | (F.lit(pending[3]) < F.col(low)))
    base = own.orderBy(low, "id").limit(1)
    span = base.select(F.col(low).alias("l"), F.col(high).alias("h"))
    target = files.where(F.col("level") == level + 1).join(F.broadcast(span), (F.col(high) >= F.col("l")) & (F.col(low) <= F.col("h")), "left_semi")
    return unless_trivial(base.select("id", F.lit("base").alias("role")).unionByName(target.select("id", F.lit("target").alias("role"))))


def unless_trivial(inputs: DataFrame) -> DataFrame:
    """No rows if there are fewer than two files."""
    many = inputs.agg(F.count("*").alias("n")).where("n > 1")
    return inputs.join(F.broadcast(many), F.lit(True), "left_semi")


def gc_candidate(groups: DataFrame, files: DataFrame, states: DataFrame) -> DataFrame:
    """``(grp, logs)``: the normal file whose group has the most value logs (ties: the least), if that is more than one."""
    most = groups.groupBy("grp").agg(F.count("*").alias("logs")).orderBy(F.col("logs").desc(), "grp").limit(1)
    return most.where("logs > 1").join(normal(files, states).select(F.col("id").alias("grp")), "grp", "left_semi")


def merge_groups(groups: DataFrame, merged: list[int], into: int) -> DataFrame:
    """``(grp, logs)``: value logs of merged groups move to a new one; logs are listed in order."""
    moved = groups.withColumn("grp", F.when(F.col("grp").isin(merged), F.lit(into).cast("long")).otherwise(F.col("grp")))
    return moved.groupBy("grp").agg(F.sort_array(F.collect_set("vfid")).alias("logs"))



def drop_groups(groups: DataFrame, gone: list[int]) -> DataFrame:
    """``(grp, vfid)`` without some groups."""
    return groups.where(~F.col("grp").isin(gone)) if gone else groups


def move_logs(groups: DataFrame, moved: DataFrame) -> DataFrame:
    """``(grp, vfid)`` after ``moved`` rows ``(vfid, into)``: a value log belongs to one group only."""
    last = moved.groupBy("vfid").agg(F.max("into").alias("into"))
    return groups.join(last, "vfid", "left").select(F.coalesce("into", "grp").alias("grp"), "vfid").distinct()


def group_of(groups: DataFrame, logs: DataFrame) -> DataFrame:
    """``(vfid, grp)`` of the asked value logs, misses as null."""
    return logs.select("vfid").distinct().join(groups.select("vfid", "grp"), "vfid", "left")
