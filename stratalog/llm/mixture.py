"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source should be taken ``target / source size`` times.  The whole
part of that number is taken by all; the fraction is a copy probability.  A pair of
documents with fractional probabilities passes word mass from one to the other, in a
random direction whose odds keep both expectations, until one of them is 0 or 1; the
one left fractional meets the next.  Blocks of some dozens of documents are folded
this way, one residual document of each block goes on to the next level of the tree,
and the last one of a source is drawn by its probability.  The words taken from a
source thus miss its target by less than one document.

Weights follow the sources' rank by code point (null last): 1, 2, 3, repeating.
Targets share the sum of all sizes by weight; a source is capped at ``cap`` times its
size and what it can't use is shared among the others by weight, until none is above.

Null and empty texts have size 0 and are taken 0 times.  Repeated rows are documents
of their own.  An empty table gives no rows.  Random numbers are hashes of ids, so
reruns agree.  Columns of ``docs`` with the names used here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

BLOCK = 24


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source with its ``source_size``.

    Sorted by cap over weight, the capped sources are a prefix; the water level is
    what is left over the weights that are left, at the first place where it fits.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    limit = F.lit(float(cap)) * F.col("source_size")
    t = sizes.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).withColumn("ratio", limit / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    weights = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", F.greatest(left, F.lit(0.0)) / weights)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"]
    return t.withColumn("target", F.when(level.isNull(), limit).otherwise(F.least(limit, level * F.col("weight")))).select("source", "source_size", "weight", "target")


def uniform(*key: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def fold(items: Column, level: int, seed: int) -> Column:
    """Pivots a block: a struct of ``done`` (array of items with p 0 or 1) and ``rest`` (the fractional item, or null)."""

    def meet(state: Column, x: Column) -> Column:
        a = state["rest"]
        mass, other = a["p"] * a["size"], x["p"] * x["size"]
        up = F.least((F.lit(1.0) - a["p"]) * a["size"], other)  # words that can go from x to a
        down = F.least(mass, (F.lit(1.0) - x["p"]) * x["size"])
        rise = uniform(F.lit(seed), F.lit(level), a["key"], x["key"]) * (up + down) < down
        move = F.when(rise, up).otherwise(-down)
        # The one that reaches its bound is set to it exactly.
        a_first = F.when(rise, (F.lit(1.0) - a["p"]) * a["size"] <= other).otherwise(mass <= (F.lit(1.0) - x["p"]) * x["size"])
        edge = F.when(rise, F.lit(1.0)).otherwise(F.lit(0.0))
        a_p = F.when(a_first, edge).otherwise(a["p"] + move / a["size"])
        x_p = F.when(a_first, x["p"] - move / x["size"]).otherwise(F.lit(1.0) - edge)
        placed = lambda item, p: F.struct(item["id"].alias("id"), item["key"].alias("key"), item["size"].alias("size"), p.alias("p"))
        decided = F.when(a_first, placed(a, a_p)).otherwise(placed(x, x_p))
        rest = F.when(a_first, placed(x, x_p)).otherwise(placed(a, a_p))
        return F.struct(F.array_append(state["done"], decided).alias("done"), rest.alias("rest"))

    empty = F.slice(items, 1, 0)
    start = F.struct(empty.alias("done"), F.element_at(items, 1).alias("rest"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, meet)


def sample(items: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """Rounds ``items`` (source, id, key, size > 0, 0 < p < 1, n: rows of the source) to ``(source, id, key, size, p)`` with p 0 or 1.

    A level's blocks are dealt by a hash of the key, about BLOCK rows each whatever
    the sizes of the sources; the number of levels is the logarithm of the largest.
    """
    decided = None
    at, level = items, 0
    while True:
        blocks = F.ceil(F.col("n") / BLOCK)
        grouped = (
            at.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "key"), blocks))
            .groupBy("source", "block")
            .agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + level), "key").alias("h"), F.struct("id", "key", "size", "p").alias("x")))).alias("xs"), F.first("n").alias("n"))
            .select("source", "n", fold(F.transform("xs", lambda s: s["x"]), level, seed).alias("f"))
        )
        grouped = scratch.save(grouped, f"level-{level}")
        done = grouped.select("source", F.inline("f.done"))
        rest = grouped.select("source", "f.rest.*", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1).alias("n"), (F.col("n") <= BLOCK).alias("last"))
        final = rest.where("last").select("source", "id", "key", "size", F.when(uniform(F.lit(seed), F.lit(-1), F.col("key")) < F.col("p"), 1.0).otherwise(0.0).alias("p"))
        step = done.unionByName(final)
        decided = step if decided is None else decided.unionByName(step)
        at, level = rest.where("not last").drop("last"), level + 1
        if at.isEmpty():
            return decided


def mix(docs: DataFrame, scratch: Scratch, cap: float = 3.0, seed: int = 7, text: str = "text") -> DataFrame:
    """Rows ``(doc_id, source, size, source_size, target, copies)``, one for each row of ``docs``."""
    sized = scratch.save(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(text).alias("size")), "sizes")
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), cap)
    n = sized.where("size > 0").groupBy("source").agg(F.count("*").alias("n"))
    aims = aims.join(n, aims["source"].eqNullSafe(n["source"]), "left").select(aims["source"], "source_size", "target", F.coalesce("n", F.lit(0)).alias("n"))
    aims = scratch.save(aims.coalesce(1), "targets")  # a row for each source
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = aims.select(F.col("source").alias("s"), "source_size", "target", "n", each.alias("each"))
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole, part = F.floor("each").cast("long"), F.col("each") - F.floor("each")
    # Rows alike in id and size are told apart by their rank, so each is a document of its own.
    fractional = rows.where("size > 0").where(part > 0)
    same = fractional.groupBy("source", "doc_id", "size", "n", "each").agg(F.count("*").alias("same"))
    rank = F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))).alias("rank")
    items = same.select("source", F.col("doc_id").alias("id"), rank, F.col("size").cast("double").alias("size"), part.alias("p"), "n")
    items = items.withColumn("key", F.xxhash64("source", "id", "size", "rank")).drop("rank")
    taken = sample(items, scratch, seed).select("source", F.col("id").alias("doc_id"), F.col("size").cast("long").alias("size"), F.col("p").cast("long").alias("extra"))
    taken = taken.join(named, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", (whole + F.col("extra")).alias("copies"))
    plain = rows.where((F.col("size") == 0) | (part == 0)).select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") == 0, F.lit(0)).otherwise(whole).cast("long").alias("copies"))
    return taken.unionByName(plain)
