"""The queries over versioned logs, each beside the SQL that says the same.

Order can't be seen in a table, so ordered queries give rank columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, hashes, sketches
from ..functions.ordering import INTEGER, sort_columns
from ..operators import blocks, cachesim, levels, log, manifest, runs, valuelog
from . import fixtures as fx
from .fixtures import ctes

LEVELS = 7
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(ctes("ev", "latest") + "SELECT key, seq, value FROM latest")
def latest_by_key(s, d):
    return log.latest(fx.ev(s, d)).orderBy(*sort_columns("key", INTEGER))


@query(ctes("ev", "latest") + "SELECT key, seq, value FROM latest WHERE key = '17'")
def point_get(s, d):
    return log.get(fx.ev(s, d), "17")


@query(ctes("ev", "latest") + "SELECT k.key, seq, value FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer) k LEFT JOIN latest ON latest.key = k.key")
def multi_get_with_misses(s, d):
    return log.multi_get(fx.ev(s, d), fx.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key")))


@query(ctes("ev") + "SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev WHERE seq <= (SELECT max(seq) // 2 FROM ev)) WHERE rn = 1")
def snapshot_get(s, d):
    """As of half of the log."""
    ev = fx.ev(s, d)
    return log.snapshot(ev, ev.agg(F.max("seq")).scalar() / 2)


@query(
    ctes("ev")
    + """, probes AS (SELECT DISTINCT CAST(c_custkey % 200 AS VARCHAR) AS key, c_custkey * 3 AS at FROM customer),
    hit AS (SELECT p.key, p.at, max(ev.seq) AS seq FROM probes p JOIN ev ON ev.key = p.key AND ev.seq <= p.at GROUP BY p.key, p.at)
    SELECT p.key, p.at, hit.seq, ev.value FROM probes p LEFT JOIN hit ON hit.key = p.key AND hit.at = p.at LEFT JOIN ev ON ev.key = hit.key AND ev.seq = hit.seq"""
)
def as_of_multi(s, d):
    probes = fx.read(s, d, "customer").select((F.col("c_custkey") % 200).cast("string").alias("key"), (F.col("c_custkey") * 3).alias("at"))
    return log.as_of(fx.ev(s, d), probes)


@query(ctes("ev") + "SELECT key, seq, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS age FROM ev")
def key_history(s, d):
    return log.history(fx.ev(s, d)).select("key", "seq", "value", F.col("age").cast("long").alias("age"))


@query(ctes("ev") + "SELECT key, count(*) AS versions, min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY key")
def version_count(s, d):
    return log.version_counts(fx.ev(s, d))


@query(ctes("ev") + "SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev) WHERE rn > 1")
def shadowed_versions(s, d):
    return log.shadowed(fx.ev(s, d))


@query(ctes("ev") + "SELECT key, seq, value FROM ev WHERE key >= '45x' ORDER BY key, seq DESC LIMIT 1")
def lower_bound_seek(s, d):
    return log.lower_bound(fx.ev(s, d), "45x")


@query(ctes("ev") + "SELECT bound, (SELECT min(key) FROM ev WHERE key >= bound) AS key FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) || 'x' AS bound FROM customer) b")
def lower_bounds_batch(s, d):
    bounds = fx.read(s, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("x")).alias("bound"))
    return log.lower_bounds(fx.ev(s, d), bounds)


@query(ctes("ev", "latest") + "SELECT key, seq, value, row_number() OVER (ORDER BY key) AS place FROM latest WHERE key >= '12' AND key <= '40'")
def range_scan_bytes(s, d):
    return log.numbered(log.scan(fx.ev(s, d), "12", "40"), sort_columns("key")).withColumn("place", F.col("place") + 1)


@query(ctes("ev", "latest") + "SELECT key, seq, value, row_number() OVER (ORDER BY CAST(key AS BIGINT), key) AS place FROM latest WHERE CAST(key AS BIGINT) >= 12 AND CAST(key AS BIGINT) <= 40")
def range_scan_int(s, d):
    return log.numbered(log.scan(fx.ev(s, d), "12", "40", INTEGER), sort_columns("key", INTEGER)).withColumn("place", F.col("place") + 1)


@query(
    ctes("ev")
    + """, batch AS (SELECT CAST(c_custkey % 300 AS VARCHAR) AS key, c_mktsegment AS value, (SELECT max(seq) FROM ev) + row_number() OVER (ORDER BY c_custkey) AS seq FROM customer),
    both_ AS (SELECT key, seq, value FROM ev UNION ALL SELECT key, seq, value FROM batch)
    SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM both_) WHERE rn = 1"""
)
def upsert_batch(s, d):
    batch = fx.read(s, d, "customer").select((F.col("c_custkey") % 300).cast("string").alias("key"), F.col("c_mktsegment").alias("value"), "c_custkey")
    return log.latest(log.upsert(fx.ev(s, d), batch, [F.col("c_custkey")]))


@query("SELECT c_name AS key, CAST(c_custkey AS BIGINT) AS seq FROM customer WHERE c_custkey % 9 <> 0")
def reject_empty_key(s, d):
    rows = fx.read(s, d, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.lit("")).otherwise(F.col("c_name")).alias("key"), F.col("c_custkey").alias("seq"))
    return log.valid_keys(rows)


@query(
    """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS key, turn AS seq, text AS value, conv_id % 5 AS writer, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY turn, conv_id) AS n FROM conversations),
    b AS (SELECT *, coalesce(sum(strlen(key) + strlen(value)) OVER (PARTITION BY writer ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM c)
    SELECT writer, key, CAST(seq AS BIGINT) AS seq, CAST(before_ // 16385 AS BIGINT) AS run FROM b"""
)
def flush_runs(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy((F.col("conv_id") % 5)).orderBy("turn", "conv_id")
    c = fx.read(s, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn"), F.col("text").alias("value"), (F.col("conv_id") % 5).alias("writer"), F.row_number().over(w).alias("seq"))
    return runs.rotate(c, group="writer").select("writer", "key", F.col("turn").alias("seq"), "run")


@query(ctes("ev", "runs") + "SELECT fid, count(*) AS entries, count(DISTINCT key) AS keys, CAST(sum(length(key) + length(value)) AS BIGINT) AS size, min(key) AS smallest, max(key) AS largest, min(seq) AS first_seq, max(seq) AS last_seq FROM runs GROUP BY fid")
def file_stats(s, d):
    return runs.file_stats(fx.runs_of(fx.ev(s, d)))


@query(ctes("ev", "runs") + "SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM runs) WHERE rn = 1")
def merge_runs(s, d):
    r = fx.runs_of(fx.ev(s, d))
    return runs.merge(r.where("fid % 2 = 0"), r.where("fid % 2 = 1"))


@query(
    ctes("ev", "runs")
    + """SELECT fid, key, seq, value FROM runs WHERE fid % 3 <> 0 UNION ALL
    SELECT CAST(NULL AS BIGINT), key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM runs WHERE fid % 3 = 0) WHERE rn = 1"""
)
def compact_level0(s, d):
    r = fx.runs_of(fx.ev(s, d))
    return runs.compact(r, r.select("fid").distinct().where("fid % 3 = 0"))


@query(
    ctes("ev", "runs", "files")
    + """SELECT k.key, level, id, row_number() OVER (PARTITION BY k.key ORDER BY level, CASE WHEN level = 0 THEN -id ELSE 0 END, smallest, id) AS rank
    FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer) k JOIN files ON k.key >= smallest AND k.key <= largest"""
)
def candidate_files(s, d):
    keys = fx.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return levels.candidate_files(fx.files(s, d), keys).withColumn("rank", F.col("rank").cast("long"))


@query(ctes("ev", "runs", "files") + "SELECT a.level, a.id AS a, b.id AS b FROM files a JOIN files b ON a.level = b.level AND a.id < b.id AND a.smallest <= b.largest AND b.smallest <= a.largest")
def file_overlaps(s, d):
    return levels.overlaps(fx.files(s, d))


SCORES = """scores AS (SELECT l.level, count(id) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes,
    CASE WHEN l.level = 0 THEN count(id) / 5.0 ELSE coalesce(sum(size), 0) / (1048576.0 * power(10.0, l.level - 1)) END AS score
    FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS level) l LEFT JOIN files ON files.level = l.level GROUP BY l.level)"""


@query(ctes("ev", "runs", "files") + ", " + SCORES + " SELECT level, files, bytes, CAST(round(score * 1000000) AS BIGINT) AS score_ppm FROM scores")
def level_scores(s, d):
    t = levels.level_scores(fx.files(s, d), LEVELS)
    return t.select("level", "files", "bytes", F.round(F.col("score") * 1000000).cast("long").alias("score_ppm"))


@query(
    ctes("ev", "runs", "files")
    + ", "
    + SCORES
    + """, top AS (SELECT max(score) AS best FROM scores)
    SELECT CAST(CASE WHEN best < 0.6 AND (SELECT score FROM scores WHERE level = 6) > 0.5 THEN 6
        WHEN best < 0.6 AND (SELECT files FROM scores WHERE level = 0) > 2 THEN 0
        WHEN best = 0 THEN 0 ELSE (SELECT min(level) FROM scores WHERE score = best) END AS INTEGER) AS level FROM top"""
)
def pick_level(s, d):
    return levels.pick_level(fx.files(s, d), LEVELS).select("level")


@query(
    ctes("ev", "runs", "files")
    + """, r AS (SELECT DISTINCT c_custkey AS rid, CAST(c_custkey AS VARCHAR) AS rl, CAST(c_custkey AS VARCHAR) || '5' AS rh FROM customer),
    f1 AS (SELECT rid, rl, rh, (SELECT min(smallest || '!' || largest) FROM files WHERE level = 1 AND largest >= rl) AS one,
        (SELECT min(smallest || '!' || largest) FROM files WHERE level = 2 AND largest >= rl) AS two,
        (SELECT count(*) FROM files WHERE level = 0 AND smallest <= rh AND largest >= rl) AS zero FROM r)
    SELECT rid, CAST(CASE WHEN zero > 0 THEN 0 WHEN one IS NOT NULL AND rh > split_part(one, '!', 1) THEN 0 WHEN two IS NOT NULL AND rh > split_part(two, '!', 1) THEN 1 ELSE 2 END AS INTEGER) AS level FROM f1"""
)
def flush_level_choice(s, d):
    r = fx.read(s, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_custkey").cast("string").alias("low"), F.concat(F.col("c_custkey").cast("string"), F.lit("5")).alias("high"))
    return levels.flush_level(fx.files(s, d), r, LEVELS)


INPUTS0 = """, base AS (SELECT f.* FROM files f JOIN states st ON st.id = f.id AND st.state = 1 WHERE level = 0), span AS (SELECT min(smallest) AS l, max(largest) AS h FROM base),
    target AS (SELECT f.* FROM files f, span WHERE level = 1 AND largest >= l AND smallest <= h),
    both_ AS (SELECT id, 'base' AS role FROM base UNION ALL SELECT id, 'target' FROM target) SELECT id, role FROM both_ WHERE (SELECT count(*) FROM both_) > 1"""


@query(ctes("ev", "runs", "files", "states") + INPUTS0)
def compaction_inputs_level0(s, d):
    f = fx.files(s, d)
    return levels.inputs_level0(f, fx.states(f))


@query(ctes("ev", "runs", "files", "states") + ", t AS (SELECT f.id FROM files f JOIN states st ON st.id = f.id AND st.state = 1 WHERE level = 6) SELECT id, 'target' AS role FROM t WHERE (SELECT count(*) FROM t) > 1")
def compaction_inputs_last(s, d):
    f = fx.files(s, d)
    return levels.inputs_last_level(f, fx.states(f), LEVELS)


@query(
    ctes("ev", "runs", "files", "states")
    + """, base AS (SELECT f.* FROM files f JOIN states st ON st.id = f.id AND st.state = 1 WHERE level = 1 AND f.id <> 31 ORDER BY smallest, id LIMIT 1),
    target AS (SELECT f.id FROM files f, base b WHERE f.level = 2 AND f.largest >= b.smallest AND f.smallest <= b.largest),
    both_ AS (SELECT id, 'base' AS role FROM base UNION ALL SELECT id, 'target' FROM target) SELECT id, role FROM both_ WHERE (SELECT count(*) FROM both_) > 1"""
)
def compaction_inputs_middle(s, d):
    f = fx.files(s, d)
    return levels.inputs_middle(f, fx.states(f), 1, (1, 31, "3", "39"))


@query(
    ctes("ev", "runs")
    + """, numbered AS (SELECT fid, key, (row_number() OVER (PARTITION BY fid ORDER BY key, seq DESC) - 1) // 16 AS block FROM runs),
    bases AS (SELECT fid, block, min(key) AS base FROM numbered GROUP BY fid, block),
    p AS (SELECT DISTINCT c_custkey % (SELECT max(fid) FROM runs) + 1 AS fid, CAST(c_custkey % 300 AS VARCHAR) AS key FROM customer)
    SELECT fid, key, coalesce((SELECT min(block) FROM bases b WHERE b.fid = p.fid AND b.base = p.key), (SELECT max(block) FROM bases b WHERE b.fid = p.fid AND b.base < p.key)) AS block FROM p"""
)
def block_floor_lookup(s, d):
    from pyspark.sql import Window

    r = fx.runs_of(fx.ev(s, d))
    w = Window.partitionBy("fid").orderBy("key", F.col("seq").desc())
    bases = r.withColumn("block", F.floor((F.row_number().over(w) - 1) / 16).cast("long")).groupBy("fid", "block").agg(F.min("key").alias("base"))
    probes = fx.read(s, d, "customer").select((F.col("c_custkey") % r.agg(F.max("fid")).scalar() + 1).alias("fid"), (F.col("c_custkey") % 300).cast("string").alias("key"))
    return runs.floor_block(bases, probes)


@query(ctes("mixed", "sep", "placed") + "SELECT fid, key, seq, tag, CASE WHEN tag = 1 THEN value END AS inline, CASE WHEN tag = 2 THEN spot END AS pos FROM placed")
def value_separation(s, d):
    return fx.separated(s, d).select("fid", "key", "seq", "tag", "inline", "pos")


@query(ctes("mixed", "sep", "placed") + "SELECT fid AS vfid, spot AS pos, record AS bytes FROM placed WHERE tag = 2")
def vlog_offsets(s, d):
    _, v = valuelog.tables(fx.separated(s, d))
    return v.select("vfid", "pos", F.col("record_bytes").alias("bytes"))


@query(ctes("ev", "runs") + "SELECT fid, seq, CAST(17 + length(key) + length(value) AS BIGINT) AS size, CAST(sum(17 + length(key) + length(value)) OVER (PARTITION BY fid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) - (17 + length(key) + length(value)) AS pos FROM runs")
def wal_offsets(s, d):
    return valuelog.wal_offsets(fx.runs_of(fx.ev(s, d)), "fid").select("fid", "seq", "size", "pos")


@query(ctes("mixed") + "SELECT fid, key, seq, value FROM mixed")
def deref_values(s, d):
    return valuelog.dereference(*valuelog.tables(fx.separated(s, d)))


LIVE = """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM placed) WHERE rn = 1)"""


@query(
    ctes("mixed", "sep", "placed")
    + LIVE
    + """ SELECT p.fid AS vfid, count(*) AS records, count(*) - count(n.key) AS dead, CAST(sum(p.record) AS BIGINT) AS bytes, CAST(sum(CASE WHEN n.key IS NULL THEN p.record ELSE 0 END) AS BIGINT) AS dead_bytes
    FROM placed p LEFT JOIN newest n ON n.fid = p.fid AND n.spot = p.spot AND n.tag = 2 WHERE p.tag = 2 GROUP BY p.fid"""
)
def garbage_bytes(s, d):
    return valuelog.garbage(*valuelog.tables(fx.separated(s, d)))


@query(
    ctes("mixed", "sep", "placed")
    + "SELECT fid + 1000 AS fid, key, seq, tag, CASE WHEN tag = 2 THEN spot END AS pos, value FROM placed"
)
def gc_rewrite(s, d):
    return valuelog.collect(*valuelog.tables(fx.separated(s, d)), F.col("fid") + 1000)


@query(
    ctes("ev", "runs", "files", "states", "groups")
    + """, c AS (SELECT grp, count(*) AS logs FROM grps GROUP BY grp), m AS (SELECT * FROM c ORDER BY logs DESC, grp LIMIT 1)
    SELECT grp, logs FROM m WHERE logs > 1 AND grp IN (SELECT f.id FROM files f JOIN states st ON st.id = f.id AND st.state = 1)"""
)
def gc_candidate(s, d):
    f = fx.files(s, d)
    return levels.gc_candidate(fx.groups(s, d), f, fx.states(f))


@query(ctes("groups") + "SELECT CASE WHEN grp IN (11, 12, 13) THEN 50 ELSE grp END AS grp, array_to_string(list_sort(list(DISTINCT vfid)), ',') AS logs FROM grps GROUP BY 1")
def group_merge(s, d):
    t = levels.merge_groups(fx.groups(s, d), [11, 12, 13], 50)
    return t.select("grp", F.array_join(F.transform("logs", lambda x: x.cast("string")), ",").alias("logs"))


@query(
    ctes("edits")
    + """, good AS (SELECT * FROM edits WHERE txn < coalesce((SELECT min(txn) FROM edits WHERE NOT complete), 9223372036854775807))
    SELECT level, id, size, smallest, largest FROM (SELECT *, row_number() OVER (PARTITION BY level, id ORDER BY txn DESC, op DESC, pos DESC) AS rn FROM good) WHERE rn = 1 AND op = 0"""
)
def manifest_replay(s, d):
    return manifest.replay(fx.edits(s, d))


@query("SELECT greatest((SELECT max(o_orderkey) FROM orders), 96) + 1 AS next_id")
def next_file_number(s, d):
    return manifest.next_file_number(fx.edits(s, d), fx.read(s, d, "orders").select("o_orderkey"))


@query(ctes("wal") + "SELECT w.fid, pos, key, seq, value FROM wal w LEFT JOIN (SELECT fid, min(pos) AS bad FROM wal WHERE NOT ok GROUP BY fid) b ON b.fid = w.fid WHERE bad IS NULL OR pos < bad")
def wal_valid_prefix(s, d):
    return manifest.valid_prefix(fx.wal(s, d)).select("fid", "pos", "key", "seq", "value")


@query(ctes("acc") + "SELECT key, count(*) AS n FROM acc GROUP BY key")
def access_frequency(s, d):
    return cachesim.frequencies(fx.accesses(s, d))


@query()
def cms_estimate(s, d):
    return sketches.count_min(fx.accesses(s, d), "key", 256)


@query("SELECT p, CAST(ceil(-ln(p) / 0.480453013918487) AS INTEGER) AS bits FROM (SELECT l_discount + 0.001 AS p FROM lineitem GROUP BY 1) t")
def bloom_size(s, d):
    p = fx.read(s, d, "lineitem").select((F.col("l_discount") + 0.001).alias("p")).distinct()
    return p.select("p", sketches.bloom_bits_per_key("p").alias("bits"))


@query(
    ctes("ev", "runs")
    + """, asked AS (SELECT DISTINCT c_custkey % (SELECT max(fid) FROM runs) + 1 AS fid, CAST(c_custkey % 700 AS VARCHAR) AS key FROM customer),
    names AS (SELECT key FROM ev UNION SELECT key FROM asked), """
    + fx.SQL["hashes"]
    + """, sized AS (SELECT fid, (greatest(count(DISTINCT key) * 10, 64) + 7) // 8 * 8 AS bits FROM runs GROUP BY fid),
    spots AS (SELECT DISTINCT r.fid, (hash + i * (hash // 131072 + hash % 131072 * 32768)) % 4294967296 % bits AS spot FROM runs r JOIN hashes h ON h.key = r.key JOIN sized z ON z.fid = r.fid, range(6) t(i)),
    tried AS (SELECT a.fid, a.key, (hash + i * (hash // 131072 + hash % 131072 * 32768)) % 4294967296 % bits AS spot FROM asked a JOIN hashes h ON h.key = a.key JOIN sized z ON z.fid = a.fid, range(6) t(i))
    SELECT t.fid, t.key, count(s.spot) = count(*) AS may_contain FROM tried t LEFT JOIN spots s ON s.fid = t.fid AND s.spot = t.spot GROUP BY t.fid, t.key"""
)
def bloom_probe(s, d):
    """Keys that are in a file and keys that aren't."""
    r = fx.runs_of(fx.ev(s, d))
    filters = sketches.bloom_filters(r, "fid", "key", 10)
    files = r.agg(F.max("fid")).scalar()
    asked = fx.read(s, d, "customer").select((F.col("c_custkey") % files + 1).alias("fid"), (F.col("c_custkey") % 700).cast("string").alias("key")).distinct()
    return sketches.probe(asked.join(filters, "fid"), "key", "filter").select("fid", "key", "may_contain")


LRU = """, t AS (SELECT *, lag(pos) OVER (PARTITION BY stream, key ORDER BY pos) AS last, lead(pos) OVER (PARTITION BY stream, key ORDER BY pos) AS nxt FROM acc),
    dist AS (SELECT a.stream, a.pos, count(*) AS n FROM t a JOIN t b ON a.stream = b.stream AND b.pos > a.last AND b.pos < a.pos AND (b.nxt IS NULL OR b.nxt >= a.pos) WHERE a.last IS NOT NULL GROUP BY a.stream, a.pos),
    seen AS (SELECT t.stream, t.pos, t.key, (t.last IS NOT NULL AND coalesce(n, 0) < 60) AS hit FROM t LEFT JOIN dist ON dist.stream = t.stream AND dist.pos = t.pos)"""


@query(ctes("acc") + LRU + " SELECT stream, pos, key, hit FROM seen")
def lru_hits(s, d):
    return cachesim.replay(fx.accesses(s, d), 60, cachesim.LRU)


@query(ctes("acc") + LRU + " SELECT stream, count(*) AS accesses, count(*) FILTER (hit) AS hits, avg(CAST(hit AS DOUBLE)) AS rate FROM seen GROUP BY stream")
def lru_hit_rate(s, d):
    return cachesim.hit_rates(cachesim.replay(fx.accesses(s, d), 60, cachesim.LRU))


@query()
def tinylfu_hits(s, d):
    return cachesim.replay(fx.accesses(s, d), 60, cachesim.TinyLFU)


@query()
def wtinylfu_hits(s, d):
    return cachesim.replay(fx.accesses(s, d), 60, cachesim.WindowTinyLFU)


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 ELSE 4 END AS bytes FROM orders")
def varint_length(s, d):
    return fx.read(s, d, "orders").select("o_orderkey", codec.varint_length("o_orderkey").alias("bytes"))


@query("SELECT o_orderkey, o_orderkey AS decoded, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 ELSE 4 END AS size FROM orders")
def varint_roundtrip(s, d):
    t = fx.read(s, d, "orders").select("o_orderkey", codec.read_varint(codec.varint("o_orderkey")).alias("v"))
    return t.select("o_orderkey", F.col("v.value").alias("decoded"), F.col("v.size").alias("size"))


@query("SELECT o_orderkey, lpad(upper(printf('%x', o_orderkey)), 16, '0') AS code, o_orderkey AS decoded FROM orders")
def be64_roundtrip(s, d):
    t = fx.read(s, d, "orders").select("o_orderkey", codec.big_endian("o_orderkey").alias("b"))
    return t.select("o_orderkey", F.hex("b").alias("code"), codec.from_big_endian("b").cast("long").alias("decoded"))


@query(ctes("ev") + "SELECT lpad(upper(printf('%x', length(key) + 8)), 2, '0') || upper(hex(CAST(key AS BLOB))) || lpad(upper(printf('%x', seq * 256 + 1)), 16, '0') AS code, key, seq FROM ev")
def internal_key_hex(s, d):
    t = fx.ev(s, d).select(codec.internal_key(F.encode("key", "UTF-8"), "seq").alias("b"))
    p = t.select(F.hex("b").alias("code"), codec.parse_internal_key("b").alias("k"))
    return p.select("code", F.decode("k.key", "UTF-8").alias("key"), "k.seq")


@query(ctes("ev") + "SELECT key, seq, upper(hex(CAST(key AS BLOB))) || lpad(upper(printf('%x', 18446744073709551615 - CAST(seq AS UBIGINT))), 16, '0') AS code, seq AS ts FROM ev")
def inverted_ts_key(s, d):
    t = fx.ev(s, d).select("key", "seq", codec.newest_first_key(F.encode("key", "UTF-8"), "seq").alias("b"))
    return t.select("key", "seq", F.hex("b").alias("code"), codec.split_newest_first("b")["ts"].alias("ts"))


@query(ctes("mixed") + "SELECT key, seq, CASE WHEN length(value) < 16 THEN length(key) + length(value) + 1 ELSE length(key) + 13 END AS bytes FROM mixed")
def estimated_size(s, d):
    return fx.mixed(s, d).select("key", "seq", codec.estimated_size("key", "value").cast("long").alias("bytes"))


@query(ctes("mixed", "sep", "placed") + "SELECT fid, key, seq, CASE WHEN tag = 1 THEN value END AS inline, CASE WHEN tag = 2 THEN fid END AS pointer_fid, CASE WHEN tag = 2 THEN spot END AS pointer_pos FROM placed")
def tagged_values(s, d):
    t = fx.separated(s, d)
    data = F.when(F.col("tag") == 1, codec.tag_inline(F.encode("inline", "UTF-8"))).otherwise(codec.tag_pointer("fid", "pos"))
    t = t.select("fid", "key", "seq", codec.read_tagged(data).alias("v"))
    return t.select("fid", "key", "seq", F.decode("v.inline", "UTF-8").alias("inline"), F.col("v.fid").alias("pointer_fid"), F.col("v.pos").alias("pointer_pos"))


@query("SELECT DISTINCT o_orderkey % 100000 AS n, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || '.sst' AS name, o_orderkey % 100000 AS fid, CAST(0 AS BIGINT) AS other FROM orders")
def file_names(s, d):
    t = fx.read(s, d, "orders").select((F.col("o_orderkey") % 100000).alias("n")).distinct()
    name = codec.file_name("n", "sst")
    return t.select("n", name.alias("name"), codec.file_number(name, "sst").alias("fid"), codec.file_number(name, "wal").alias("other"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey <= 1 THEN o_orderkey ELSE CAST(power(2, length(bin(o_orderkey - 1))) AS BIGINT) END AS power FROM orders")
def next_power(s, d):
    return fx.read(s, d, "orders").select("o_orderkey", codec.next_power_of_2("o_orderkey").alias("power"))


@query(ctes("ev", "crcs") + "SELECT seq, crc FROM ev JOIN crcs ON crcs.value = ev.value")
def crc32c(s, d):
    return fx.ev(s, d).select("seq", hashes.crc32c(F.encode("value", "UTF-8")).alias("crc"))


@query(ctes("ev") + ", names AS (SELECT key FROM ev), " + fx.SQL["hashes"] + " SELECT seq, hash FROM ev JOIN hashes ON hashes.key = ev.key")
def murmurish_hash(s, d):
    return fx.ev(s, d).select("seq", hashes.hash32(F.encode("key", "UTF-8")).alias("hash"))


@query(ctes("mixed", "sep", "placed", "cut") + 'SELECT fid, key, seq, CAST(block AS BIGINT) AS block, CAST(overlap AS BIGINT) AS overlap, CAST(start AS BIGINT) AS "offset", CAST(bytes AS BIGINT) AS bytes FROM cut')
def block_layout(s, d):
    t = fx.separated(s, d)
    size = F.when(F.col("tag") == 1, 1 + F.octet_length("value")).otherwise(13)
    return blocks.layout(t.select("fid", "key", "seq", size.alias("tagged_bytes")))


@query(
    ctes("mixed", "sep", "placed", "cut")
    + """, b AS (SELECT fid, CAST(block AS BIGINT) AS block, any_value(base) AS base, count(*) AS entries, CAST(sum(bytes) + 4 * count(*) + 16 AS BIGINT) AS bytes FROM cut GROUP BY 1, 2)
    SELECT *, CAST(sum(bytes) OVER (PARTITION BY fid ORDER BY block) - bytes AS BIGINT) AS "offset" FROM b"""
)
def block_index(s, d):
    return blocks.block_index(block_layout(s, d))


@query(
    ctes("ev", "runs")
    + """, m AS (SELECT fid, min(key) AS base FROM runs GROUP BY fid)
    SELECT DISTINCT r.fid, r.key, CAST(list_max(list_filter(range(least(length(key), length(base)) + 1), lambda i: key[:i] = base[:i])) AS INTEGER) AS overlap FROM runs r JOIN m ON m.fid = r.fid"""
)
def prefix_overlap(s, d):
    r = fx.runs_of(fx.ev(s, d)).select("fid", "key").distinct()
    base = r.groupBy("fid").agg(F.min("key").alias("base"))
    return r.join(base, "fid").select("fid", "key", blocks.common_prefix("key", "base").alias("overlap"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
