"""A store on a directory of Parquet files: set, get, flush, compact, collect, recover.

``log/`` holds batches as they come, ``runs/fid=N/`` sorted files by level, ``values/vfid=N/``
the large values that files point to, and ``manifest/`` one row for each file added or
dropped, in transactions, with the last number given.  A reader sees the files of
complete transactions only, so a writer that dies leaves no trace but files that nothing
names, which :meth:`Store.vacuum` deletes.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import sort_columns
from ..model import CREATE, DELETE, ENTRY, POINTER, EmptyKey, KeyNotFound, Options
from ..operators import levels, log, manifest, runs, valuelog
from . import binary

MANIFEST = "txn long, pos int, op int, level int, id long, size long, smallest string, largest string, complete boolean, last_seq long"
SORTED = "key string, seq long, tag int, inline string, vfid long, pos long"
VALUES = "pos long, key string, value string"
#: What the manifest has as the level of batches that no file holds yet, and of value logs.
WAITING, VALUE_LOG = -1, -2


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options

    # What there is.

    def exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def edits(self) -> DataFrame:
        if not self.exists("manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def files(self) -> DataFrame:
        return manifest.replay(self.edits())

    def read(self, folder: str, name: str, ids: Iterable[int], schema: str) -> DataFrame:
        """The rows of numbered files with their numbers; the numbers prune what is opened."""
        ids = sorted(ids)
        if not ids:
            return self.spark.createDataFrame([], f"{schema}, {name} long")
        paths = [f"{self.path}/{folder}/{name}={i}" for i in ids]
        return self.spark.read.schema(f"{schema}, {name} long").option("basePath", f"{self.path}/{folder}").parquet(*paths)

    def sorted_entries(self, ids: Iterable[int]) -> DataFrame:
        """``(fid, key, seq, tag, inline, vfid, pos)`` of sorted files."""
        return self.read("runs", "fid", ids, SORTED).select("fid", "key", "seq", "tag", "inline", "vfid", "pos")

    def values(self) -> DataFrame:
        """``(vfid, pos, key, value)`` of all live value logs."""
        return self.read("values", "vfid", (r["id"] for r in self.live() if r["level"] == VALUE_LOG), VALUES).select("vfid", "pos", "key", "value")

    def entries(self, ids: Iterable[int], key: str | None = None) -> DataFrame:
        """``(fid, key, seq, value)`` of sorted files, with a key only its own: both filters reach the scans."""
        entries, values = self.sorted_entries(ids), self.values()
        if key is not None:
            entries, values = entries.where(F.col("key") == key), values.where(F.col("key") == key)
        return valuelog.dereference(entries, values).select("fid", "key", "seq", "value")

    def live(self) -> list:
        """The files' metadata: one row a file, never the data."""
        return self.files().collect()

    def unflushed(self) -> DataFrame:
        """Batches that no file holds yet."""
        waiting = {r["id"] for r in self.live() if r["level"] == WAITING}
        out = self.spark.createDataFrame([], ENTRY)
        for b in sorted(waiting):
            out = out.unionByName(self.spark.read.schema(ENTRY).parquet(f"{self.path}/log/batch={b}"))
        return out

    def log(self, key: str | None = None) -> DataFrame:
        """All versions; with a key, only of files whose range holds it."""
        live = [r for r in self.live() if r["level"] >= 0]
        if key is not None and self.options.ordering == "bytes":
            live = [r for r in live if r["smallest"] <= key <= r["largest"]]
        return self.entries([r["id"] for r in live], key).select("key", "seq", "value").unionByName(self.unflushed())

    # Changes.

    def commit(self, rows: list[tuple], last_seq: int | None = None) -> None:
        """rows: (op, level, id, size, smallest, largest); one transaction."""
        txn = (self.edits().agg(F.max("txn")).first()[0] or 0) + 1
        full = [(txn, i, *r, True, last_seq) for i, r in enumerate(rows)]
        self.spark.createDataFrame(full, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def next_id(self) -> int:
        return manifest.next_file_number(self.edits()).first()[0]

    def next_seq(self) -> int:
        """One more than the last number given, which the manifest keeps."""
        return (self.edits().where("complete").agg(F.max("last_seq")).first()[0] or 0) + 1

    def put(self, batch: DataFrame, order: list) -> None:
        """Appends ``(key, value)`` rows, numbered in an order.

        Rows are dealt by range and numbered within partitions, so no task sees the
        whole batch; the partitions' sizes, one number each, make the numbers dense.
        """
        if batch.where("key is null or key = ''").limit(1).count():
            raise EmptyKey("a batch has an empty key")
        base = self.next_seq()
        self.append(log.numbered(batch, order, "_seq").select("key", (F.lit(base) + F.col("_seq")).alias("seq"), "value"))

    def append(self, rows: DataFrame) -> None:
        number = self.next_id()
        path = f"{self.path}/log/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        last = self.spark.read.schema(ENTRY).parquet(path).agg(F.max("seq")).first()[0]
        self.commit([(CREATE, WAITING, number, 0, None, None)], max(last or 0, self.next_seq() - 1))

    def recover(self, folder: str, strict: bool = False) -> int:
        """Takes in the commit logs ``*.wal`` of a folder with their numbers, each up to its first damage, and returns how many entries.

        With ``strict`` damage raises.  Numbers that the store has already given are left out, so a recovery can be repeated.
        """
        found = binary.read(self.spark, folder, "wal", strict).withColumn("ok", F.lit(True))
        rows = manifest.recover(found).select(F.decode("key", "UTF-8").alias("key"), "seq", F.decode("value", "UTF-8").alias("value"))
        rows = log.pinned(rows.where(F.col("seq") >= self.next_seq()))
        n = rows.count()
        if n:
            self.append(rows)
        return n

    def set(self, key: str, value: str | None) -> None:
        if not key:
            raise EmptyKey(key)
        self.put(self.spark.createDataFrame([(key, value)], "key string, value string"), [F.col("key")])

    def dealt(self, rows: DataFrame, size: int) -> tuple[DataFrame, list[int]]:
        """Rows with ``fid``: new files of about the table size each, by key ranges, so that a key's versions share one."""
        number, count = self.next_id(), max(1, -(-size // self.options.table_size))
        order = sort_columns("key", self.options.ordering)
        parts = log.pinned(rows.repartitionByRange(count, *order).withColumn("fid", F.lit(number) + F.spark_partition_id()))
        return parts, [number + i for i in range(count)]

    def write_files(self, parts: DataFrame) -> None:
        """``(fid, ...)`` as sorted files, a file a task."""
        order = [*sort_columns("key", self.options.ordering), F.col("seq").desc()]
        rows = parts.select("fid", "key", "seq", "tag", "inline", "vfid", "pos").repartition("fid").sortWithinPartitions("fid", *order)
        rows.write.mode("append").partitionBy("fid").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/runs")

    def name(self, ids: list[int], level: int | None, drops: list[tuple[int, int]], values: list[int] = []) -> list[int]:
        """Commits new files, and what they replace, in one transaction; their numbers."""
        stored = self.sorted_entries(i for i in ids if self.exists(f"runs/fid={i}"))
        size = F.coalesce(F.octet_length("inline"), F.lit(0))
        stats = stored.groupBy("fid").agg(F.sum(F.octet_length("key") + size).alias("size"), F.min("key").alias("smallest"), F.max("key").alias("largest")).collect()
        at = {}
        if level is None and stats:
            spans = self.spark.createDataFrame([(r["fid"], r["smallest"], r["largest"]) for r in stats], "rid long, low string, high string")
            at = {r["rid"]: r["level"] for r in levels.flush_level(self.files().where("level >= 0"), spans, self.options.max_levels).collect()}
        new = [(CREATE, at.get(r["fid"], level), r["fid"], r["size"], r["smallest"], r["largest"]) for r in sorted(stats, key=lambda r: r["fid"])]
        new += [(CREATE, VALUE_LOG, v, 0, None, None) for v in values]
        self.commit([*new, *((DELETE, lv, i, 0, None, None) for lv, i in drops)])
        return [r["fid"] for r in stats]

    def write_apart(self, rows: DataFrame, level: int | None, drops: list[tuple[int, int]]) -> list[int]:
        """``(key, seq, value)`` as new files whose large values go to value logs of the same numbers."""
        size = rows.agg(F.sum(runs.payload())).first()[0] or 0
        parts, ids = self.dealt(rows, size)
        apart = valuelog.separate(parts)
        entries, values = valuelog.tables(apart)
        self.write_files(entries)
        values.select("vfid", "pos", "key", "value").repartition("vfid").sortWithinPartitions("vfid", "pos").write.mode("append").partitionBy("vfid").parquet(f"{self.path}/values")
        return self.name(ids, level, drops, [i for i in ids if self.exists(f"values/vfid={i}")])

    def flush(self) -> list[int] | None:
        """Moves unflushed batches, with all their versions, into sorted files and value logs."""
        waiting = [(WAITING, r["id"]) for r in self.live() if r["level"] == WAITING]
        return self.write_apart(self.unflushed(), None, waiting) if waiting else None

    def compact(self, pending: tuple[int, int, str, str] | None = None) -> list[int] | None:
        """Merges the files that the level scores ask for into the next level; values stay where they are.

        A level between the first and the last merges for a pending collection only.
        """
        live = [r for r in self.live() if r["level"] >= 0]
        meta = self.files().where("level >= 0")
        states = meta.select("id", F.lit(1).alias("at"), F.lit(1).alias("state"))
        level, last = levels.pick_level(meta, self.options.max_levels).first()["level"], self.options.max_levels - 1
        if level == 0:
            chosen = levels.inputs_level0(meta, states)
        elif level == last:
            chosen = levels.inputs_last_level(meta, states, self.options.max_levels)
        else:
            chosen = levels.inputs_middle(meta, states, level, pending)
        ids = {r["id"] for r in chosen.collect()}
        if not ids:
            return None
        newest = self.sorted_entries(ids).groupBy("key").agg(F.max_by(F.struct("seq", "tag", "inline", "vfid", "pos"), "seq").alias("v")).select("key", "v.*")
        size = sum(r["size"] for r in live if r["id"] in ids)
        parts, made = self.dealt(newest, size)
        self.write_files(parts)
        return self.name(made, min(level + 1, last), [(r["level"], r["id"]) for r in live if r["id"] in ids])

    def collect(self) -> list[int] | None:
        """Rewrites the file that points into the most value logs, if it is more than one, with a log of its own; logs that no file points into go."""
        meta = self.files().where("level >= 0")
        states = meta.select("id", F.lit(1).alias("at"), F.lit(1).alias("state"))
        all_ = self.live()
        live = {r["id"]: r["level"] for r in all_ if r["level"] >= 0}
        entries = self.sorted_entries(live)
        groups = log.pinned(entries.where(F.col("tag") == POINTER).select(F.col("fid").alias("grp"), "vfid").distinct())
        chosen = levels.gc_candidate(groups, meta, states).first()
        pointed = {r["vfid"] for r in groups.where(F.col("grp") != (chosen["grp"] if chosen else -1)).select("vfid").distinct().collect()}
        unused = [(VALUE_LOG, r["id"]) for r in all_ if r["level"] == VALUE_LOG and r["id"] not in pointed]
        if chosen is None:
            if unused:
                self.commit([(DELETE, lv, i, 0, None, None) for lv, i in unused])
            return None
        old = chosen["grp"]
        return self.write_apart(self.entries([old]).select("key", "seq", "value"), live[old], [(live[old], old), *unused])

    def vacuum(self) -> list[str]:
        """Deletes the files that the manifest doesn't name; nothing else may be reading or writing."""
        live = {({WAITING: "log", VALUE_LOG: "values"}.get(r["level"], "runs"), r["id"]) for r in self.live()}
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        gone = []
        for folder in ("runs", "values", "log"):
            if not self.exists(folder):
                continue
            path = fs.Path(f"{self.path}/{folder}")
            system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for found in system.listStatus(path):
                name = found.getPath().getName()
                if "=" in name and (folder, int(name.split("=")[1])) not in live:
                    system.delete(found.getPath(), True)
                    gone.append(f"{folder}/{name}")
        return sorted(gone)

    # Questions.

    def get(self, key: str) -> str | None:
        """The latest value; a miss is None, as is a null value."""
        row = log.get(self.log(key), key).first()
        return row["value"] if row else None

    def get_as_of(self, key: str, seq: int) -> str | None:
        row = log.get(self.log(key).where(F.col("seq") <= seq), key).first()
        if row is None:
            raise KeyNotFound(key)
        return row["value"]

    def scan(self, low: str | None = None, high: str | None = None) -> DataFrame:
        return log.scan(self.log(), low, high, self.options.ordering)
