"""How the driver's tables are read as logs, runs, files and manifests, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs, valuelog

RUN = 1000

#: Common table expressions that say the same in SQL.
SQL = {
    "ev": "ev AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id + 1 AS seq, event_type AS value FROM events)",
    "latest": "latest AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev) WHERE rn = 1)",
    "ord": "ord AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS seq, o_orderpriority AS value, CAST(1 + o_orderkey // 5000 AS BIGINT) AS fid FROM orders)",
    "mixed": "mixed AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS key, o_orderkey * 2 AS seq, o_orderpriority AS value, CAST(1 + o_orderkey // 5000 AS BIGINT) AS fid FROM orders UNION ALL SELECT 'c' || CAST(c_custkey % 700 AS VARCHAR), c_custkey * 2 + 1, c_name, CAST(1 + c_custkey // 400 AS BIGINT) FROM customer)",
    "runs": "runs AS (SELECT *, 1 + (seq - 1) // 1000 AS fid FROM ev)",
    "files": "files AS (SELECT CAST((fid * 10 + CAST(substr(key, 1, 1) AS BIGINT)) % 7 AS INTEGER) AS level, fid * 10 + CAST(substr(key, 1, 1) AS BIGINT) AS id, CAST(sum(length(key) + length(value)) AS BIGINT) * 40 AS size, min(key) AS smallest, max(key) AS largest FROM runs GROUP BY 1, 2)",
    "states": "states AS (SELECT id, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS state FROM files WHERE id % 11 <> 6)",
    "sep": """sep AS (SELECT *, CASE WHEN length(value) > 15 THEN 2 ELSE 1 END AS tag,
        CASE WHEN length(value) > 15 THEN CAST(5 + (CASE WHEN length(key) < 128 THEN 1 ELSE 2 END) + (CASE WHEN length(value) < 128 THEN 1 WHEN length(value) < 16384 THEN 2 ELSE 3 END) + length(key) + length(value) AS BIGINT) ELSE 0 END AS record FROM mixed)""",
    "placed": "placed AS (SELECT *, CAST(sum(record) OVER (PARTITION BY fid ORDER BY key, seq DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) - record AS spot FROM sep)",
    "groups": "grps AS (SELECT DISTINCT user_id % 12 + 10 AS grp, event_id % 40 % (user_id % 12 + 5) AS vfid FROM events)",
    "edits": """edits AS (SELECT event_id // 50 AS txn, CAST(event_id % 50 AS INTEGER) AS pos, CASE WHEN value > 60 THEN 1 ELSE 0 END AS op, CAST(user_id % 4 AS INTEGER) AS level,
        event_id % 97 AS id, event_id * 10 AS size, 'a' || CAST(event_id AS VARCHAR) AS smallest, 'b' || CAST(user_id AS VARCHAR) AS largest, event_id // 50 < (SELECT max(event_id) // 50 - 3 FROM events) AS complete FROM events)""",
    "wal": "wal AS (SELECT event_id // 500 AS fid, event_id % 500 AS pos, CAST(user_id AS VARCHAR) AS key, event_id + 1 AS seq, event_type AS value, event_id % 911 <> 7 AS ok FROM events)",
    # The 32-bit hash of every key: four bytes at a time, then what is left.
    "hashes": """folded AS (SELECT key, list_reduce(list_concat([CAST(xor(3164544308, CAST(length(key) * 3332679571 % 4294967296 AS BIGINT)) AS HUGEINT)],
        list_transform(range(length(key) // 4), lambda i: CAST(ascii(key[4 * i + 1]) + 256 * ascii(key[4 * i + 2]) + 65536 * ascii(key[4 * i + 3]) + 16777216 * CAST(ascii(key[4 * i + 4]) AS HUGEINT) AS HUGEINT))),
        lambda h, w: xor((h + w) * 3332679571 % 4294967296, (h + w) * 3332679571 % 4294967296 // 65536)) AS h,
        CAST(coalesce(list_sum(list_transform(range(length(key) % 4), lambda i: ascii(key[length(key) // 4 * 4 + i + 1]) * [1, 256, 65536][i + 1])), 0) AS HUGEINT) AS rest FROM (SELECT DISTINCT key FROM names)),
        hashes AS (SELECT key, CAST(CASE WHEN length(key) % 4 = 0 THEN h ELSE xor((h + rest) * 3332679571 % 4294967296, (h + rest) * 3332679571 % 4294967296 // 16777216) END AS BIGINT) AS hash FROM folded)""",
    # The table of the reflected checksum by eight divisions, and its use byte by byte.
    "crcs": """tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 2197175160) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
        crcs AS (SELECT value, xor(list_reduce(list_concat([4294967295], list_transform(range(length(value)), lambda i: CAST(ascii(value[i + 1]) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM (SELECT DISTINCT value FROM ev), tbl)""",
    # Entries of a file one after the other: one that doesn't fit begins a block.
    "cut": """sized AS (SELECT fid, key, seq, CASE WHEN tag = 1 THEN 1 + length(value) ELSE 13 END AS size, row_number() OVER (PARTITION BY fid ORDER BY key, seq DESC) AS n FROM placed),
        cut AS (SELECT fid, n, key, seq, 0 AS block, 0 AS overlap, 0 AS start, 12 + length(key) + size AS bytes, 1 AS held, key AS base FROM sized WHERE n = 1
        UNION ALL SELECT fid, n, key, seq, CASE WHEN fits THEN block ELSE block + 1 END, CASE WHEN fits THEN lap ELSE 0 END, CASE WHEN fits THEN after_ ELSE 0 END, 12 + length(key) - (CASE WHEN fits THEN lap ELSE 0 END) + size, CASE WHEN fits THEN held + 1 ELSE 1 END, CASE WHEN fits THEN base ELSE key END
        FROM (SELECT s.*, c.block, c.held, c.base, c.start + c.bytes AS after_, c.start + c.bytes + 6 + length(s.key) + s.size + 4 * (c.held + 1) + 16 <= 1024 AS fits,
            list_max(list_filter(range(least(length(s.key), length(c.base)) + 1), lambda i: s.key[:i] = c.base[:i])) AS lap FROM cut c JOIN sized s ON s.fid = c.fid AND s.n = c.n + 1))""",
    "acc": "acc AS (SELECT user_id % 3 AS stream, event_id AS pos, event_type || CAST(user_id % 40 AS VARCHAR) AS key FROM events)",
}


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + " "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("value"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), (F.col("o_orderkey") * 2).alias("seq"), F.col("o_orderpriority").alias("value"), (1 + F.floor(F.col("o_orderkey") / 5000)).cast("long").alias("fid"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 700).cast("string")).alias("key"), (F.col("c_custkey") * 2 + 1).alias("seq"), F.col("c_name").alias("value"), (1 + F.floor(F.col("c_custkey") / 400)).cast("long").alias("fid"))
    return o.unionByName(c)


def runs_of(log: DataFrame) -> DataFrame:
    return log.withColumn("fid", (1 + F.floor((F.col("seq") - 1) / RUN)).cast("long"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each run and first digit of its keys, so that ranges differ."""
    r = runs_of(ev(spark, sf_dir)).withColumn("fid", F.col("fid") * 10 + F.substring("key", 1, 1).cast("long"))
    s = runs.file_stats(r)
    return s.select((F.col("fid") % 7).cast("int").alias("level"), F.col("fid").alias("id"), (F.col("size") * 40).alias("size"), "smallest", "largest")


def states(f: DataFrame) -> DataFrame:
    """An earlier state and the last one of each file; some files have none."""
    some = f.where(F.col("id") % 11 != 6)
    early = some.select("id", F.lit(1).alias("at"), F.lit(3).alias("state"))
    return early.unionByName(some.select("id", F.lit(2).alias("at"), F.when(F.col("id") % 5 == 0, 2).otherwise(1).alias("state")))


def separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuelog.separate(mixed(spark, sf_dir))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grp = F.col("user_id") % 12
    return read(spark, sf_dir, "events").select((grp + 10).alias("grp"), (F.col("event_id") % 40 % (grp + 5)).alias("vfid")).distinct()


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    last = e.agg(F.floor(F.max("event_id") / 50)).scalar()
    txn = F.floor(F.col("event_id") / 50).cast("long")
    return e.select(txn.alias("txn"), (F.col("event_id") % 50).cast("int").alias("pos"), F.when(F.col("value") > 60, 1).otherwise(0).alias("op"), (F.col("user_id") % 4).cast("int").alias("level"), (F.col("event_id") % 97).alias("id"), (F.col("event_id") * 10).alias("size"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("smallest"), F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("largest"), (txn < last - 3).alias("complete"))


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("fid"), (F.col("event_id") % 500).alias("pos"), F.col("user_id").cast("string").alias("key"), (F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("value"), (F.col("event_id") % 911 != 7).alias("ok"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("stream"), F.col("event_id").alias("pos"), F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("key"))

