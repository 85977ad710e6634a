"""Cache replacement over access streams ``(stream, pos, key)``.

LRU hits have a parallel form: an access hits if fewer than ``capacity`` other keys
were used since the key's last one.  The frequency policies are sequential by nature;
each stream is replayed in order by one task, streams in parallel.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.sketches import CountMin


def lru_hits(accesses: DataFrame, capacity: int) -> DataFrame:
    """Adds ``hit`` by stack distance; the join pairs an access with the keys used in between."""
    w = Window.partitionBy("stream", "key").orderBy("pos")
    t = accesses.select("stream", "pos", "key").withColumn("last", F.lag("pos").over(w)).withColumn("next", F.lead("pos").over(w))
    # A key counts once in a gap: by its last use before the access.
    a = t.where("last is not null").select("stream", "pos", "last")
    b = t.select("stream", F.col("pos").alias("p"), F.col("next").alias("n"))
    between = a.join(b, "stream").where("p > last and p < pos and (n is null or n >= pos)").groupBy("stream", "pos").agg(F.count("*").alias("distance"))
    out = t.join(between, ["stream", "pos"], "left")
    return out.select("stream", "pos", "key", (F.col("last").isNotNull() & (F.coalesce("distance", F.lit(0)) < capacity)).alias("hit"))


def key_hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key)


class LRU:
    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def access(self, key: str) -> bool:
        """Looks a key up and, on a miss, puts it in."""
        if key in self.held:
            self.held.move_to_end(key)
            return True
        if len(self.held) >= self.capacity:
            self.held.popitem(last=False)
        self.held[key] = True
        return False


class TinyLFU:
    """Keeps keys in order of estimated frequency; a newcomer replaces the least if it is estimated no lower."""

    def __init__(self, capacity: int):
        self.capacity, self.sketch, self.held, self.puts = capacity, CountMin(capacity), [], 0

    def estimate(self, key: str) -> int:
        return self.sketch.estimate(key_hash(key))

    def settle(self, key: str, at: int) -> None:
        """Moves a key up past all that aren't estimated higher."""
        mine = self.estimate(key)
        while at > 0 and self.estimate(self.held[at - 1]) <= mine:
            at -= 1
        self.held.insert(at, key)

    def access(self, key: str) -> bool:
        self.sketch.increment(key_hash(key))
        if key in self.held:
            at = self.held.index(key)
            del self.held[at]
            self.settle(key, at)
            return True
        self.puts += 1
        if self.puts == self.capacity:
            self.sketch.halve()
            self.puts = 0
        if len(self.held) == self.capacity:
            if self.estimate(self.held[-1]) > self.estimate(key):
                return False
            self.held.pop()
        self.settle(key, len(self.held))
        return False


class WindowTinyLFU:
    """A small window of recent keys before a main area of a probation and a protected segment.

    What leaves the window enters probation if there is room, or if it is estimated
    higher than probation's oldest.  A hit in probation protects a key; the protected
    segment's oldest goes back.
    """

    def __init__(self, capacity: int):
        self.window_size = max(1, capacity // 100)
        main = max(capacity - self.window_size, 1)
        self.protected_size = main * 8 // 10
        self.main = main
        self.window, self.probation, self.protected = OrderedDict(), OrderedDict(), OrderedDict()
        self.sketch, self.capacity, self.puts = CountMin(capacity), capacity, 0

    def access(self, key: str) -> bool:
        self.sketch.increment(key_hash(key))
        for part in (self.window, self.protected):
            if key in part:
                part.move_to_end(key)
                return True
        if key in self.probation:
            del self.probation[key]
            self.protected[key] = True
            if len(self.protected) > self.protected_size:
                old, _ = self.protected.popitem(last=False)
                self.probation[old] = True
            return True
        self.put(key)
        return False

    def put(self, key: str) -> None:
        self.puts += 1
        if self.puts == self.capacity:
            self.sketch.halve()
            self.puts = 0
        self.window[key] = True
        if len(self.window) <= self.window_size:
            return
        leaver, _ = self.window.popitem(last=False)
        if len(self.probation) + len(self.protected) < self.main:
            self.probation[leaver] = True
        elif self.probation:
            victim = next(iter(self.probation))
            if self.sketch.estimate(key_hash(leaver)) > self.sketch.estimate(key_hash(victim)):
                del self.probation[victim]
                self.probation[leaver] = True


def replay(accesses: DataFrame, capacity: int, policy: Callable[[int], object]) -> DataFrame:
    """Adds ``hit`` by replaying each stream in order.

    Streams are sorted by Spark, which spills, and pass through Python batch by batch:
    it holds one cache and one batch, however long a stream is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, current = None, None
        for batch in batches:
            hits = []
            for stream, key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if cache is None or stream != current:
                    cache, current = policy(capacity), stream
                hits.append(cache.access(key))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], names=[*batch.schema.names, "hit"])

    rows = accesses.select("stream", "pos", "key")
    return rows.repartition("stream").sortWithinPartitions("stream", "pos").mapInArrow(run, StructType([*rows.schema.fields, StructField("hit", BooleanType())]))


def hit_rates(hits: DataFrame) -> DataFrame:
    return hits.groupBy("stream").agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("int")).alias("rate"))


def frequencies(accesses: DataFrame) -> DataFrame:
    return accesses.groupBy("key").agg(F.count("*").alias("n"))
