"""Operators against small models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import codec, sketches
from stratalog.functions.hashes import crc32c_many, hash32_many
from stratalog.functions.ordering import INTEGER, folded, sort_columns
from stratalog.model import EmptyKey
from stratalog.operators import blocks, cachesim, levels, log, manifest, runs, valuelog

ENTRY = "key string, seq long, value string"


@pytest.fixture(scope="module")
def versions():
    rng = random.Random(3)
    return [(str(rng.randrange(60)), i + 1, rng.choice([None, "", "v", "a longer value than fifteen bytes"])) for i in range(500)]


@pytest.fixture(scope="module")
def entries(spark, versions):
    return spark.createDataFrame(versions, ENTRY).cache()


def newest(rows, seq=10**9):
    out = {}
    for k, s, v in rows:
        if s <= seq and (k not in out or s > out[k][0]):
            out[k] = (s, v)
    return out


def test_latest_and_lookups(spark, entries, versions):
    want = newest(versions)
    assert {r.key: (r.seq, r.value) for r in log.latest(entries).collect()} == want
    assert tuple(log.get(entries, "7").first()) == ("7", *want["7"])
    assert log.get(entries, "nope").count() == 0
    with pytest.raises(EmptyKey):
        log.get(entries, "")
    got = log.multi_get(entries, spark.createDataFrame([("7",), ("x",), ("7",)], "key string")).collect()
    assert {r.key: (r.seq, r.value) for r in got} == {"7": want["7"], "x": (None, None)} and len(got) == 2


def test_as_of(spark, entries, versions):
    probes = [(str(k), s) for k in range(0, 65, 3) for s in (0, 1, 100, 333, 500, 900)]
    got = {(r.key, r["at"]): (r.seq, r.value) for r in log.as_of(entries, spark.createDataFrame(probes, "key string, at long")).collect()}
    assert got == {(k, s): newest(versions, s).get(k, (None, None)) for k, s in probes}
    assert {r.key: r.seq for r in log.snapshot(entries, 333).collect()} == {k: v[0] for k, v in newest(versions, 333).items()}


def test_bounds_and_scans(spark, entries, versions):
    keys = sorted({k for k, _, _ in versions})
    assert log.lower_bound(entries, "33x").first().key == next(k for k in keys if k >= "33x")
    assert log.lower_bound(entries, "zzz").count() == 0
    bounds = ["", "0", "33x", "5", "59", "9", "zz"]
    got = {r.bound: r.key for r in log.lower_bounds(entries, spark.createDataFrame([(b,) for b in bounds], "bound string")).collect()}
    assert got == {b: next((k for k in keys if k >= b), None) for b in bounds}
    assert [r.key for r in log.scan(entries, "2", "31").collect()] == [k for k in keys if "2" <= k <= "31"]
    assert [r.key for r in log.scan(entries, "2", "31", INTEGER).collect()] == sorted((k for k in keys if 2 <= int(k) <= 31), key=int)


def test_integer_order(spark):
    def value(k):
        v = 0
        for b in k.encode():
            v = (v * 10 + b - 48) % (1 << 64)
        return v - (1 << 64) if v >= 1 << 63 else v

    keys = ["", "0", "007", "7", "9", "10", "9" * 18, "9" * 19, "9" * 23, "-5", "a", "zé", "00"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {r.key: r.v for r in df.select("key", folded("key").alias("v")).collect()} == {k: value(k) for k in keys}
    assert [r.key for r in df.orderBy(*sort_columns("key", INTEGER)).collect()] == sorted(keys, key=lambda k: (value(k), k.encode()))


def test_history_and_shadowed(entries, versions):
    want = newest(versions)
    assert log.shadowed(entries).count() == len(versions) - len(want)
    rows = log.history(entries).collect()
    assert [(r.key, -r.seq) for r in rows] == sorted((k, -s) for k, s, _ in versions)
    assert sum(r.age == 1 for r in rows) == len(want)


def test_upsert_and_keys(spark, entries):
    batch = spark.createDataFrame([("7", "new"), ("k", "x")], "key string, value string")
    got = {r.key: (r.seq, r.value) for r in log.latest(log.upsert(entries, batch, [F.col("key")])).collect()}
    assert got["7"] == (501, "new") and got["k"] == (502, "x")
    bad = spark.createDataFrame([("",), (None,), ("a",)], "key string")
    assert log.valid_keys(bad).count() == 1
    with pytest.raises(Exception, match="empty key"):
        log.require_keys(bad).collect()


def test_runs(spark, entries, versions):
    cut = entries.withColumn("fid", F.floor((F.col("seq") - 1) / 100).cast("long"))
    parts = [cut.where(F.col("fid") == i) for i in range(5)]
    assert {r.key: (r.seq, r.value) for r in runs.merge(*parts).collect()} == newest(versions)
    out = runs.compact(cut, spark.createDataFrame([(0,), (3,)], "fid long")).collect()
    old = [v for v in versions if (v[1] - 1) // 100 in (0, 3)]
    assert {r.key: (r.seq, r.value) for r in out if r.fid is None} == newest(old)
    assert sum(r.fid is not None for r in out) == 300
    small = runs.rotate(entries, __import__("stratalog.model", fromlist=["Options"]).Options(memtable_size=1000))
    sizes = {r.run: r.n for r in small.groupBy("run").agg(F.sum(runs.payload()).alias("n")).collect()}
    assert sorted(sizes) == list(range(len(sizes))) and all(n <= 1100 for n in sizes.values())


def test_value_log(entries, versions):
    sep = valuelog.separate(entries.withColumn("fid", F.col("seq") % 3)).cache()
    sst, vlog = valuelog.tables(sep)
    assert {(r.key, r.seq): r.value for r in valuelog.dereference(sst, vlog).collect()} == {(k, s): v for k, s, v in versions}
    assert valuelog.dangling(sst, vlog).count() == 0
    for f in range(3):
        rows = sorted((k, -s, v) for k, s, v in versions if s % 3 == f and v and len(v) > 15)
        at, want = 0, []
        for k, s, v in rows:
            want.append((k, -s, at))
            at += 7 + len(k) + len(v)
        assert [(r.key, r.seq, r.pos) for r in sep.where(f"fid = {f} and tag = 2").orderBy("key", F.desc("seq")).collect()] == want
    live = {k for k, (_, v) in newest(versions).items() if v and len(v) > 15}
    g = valuelog.garbage(sst, vlog).collect()
    assert sum(r.records - r.dead for r in g) == len(live) and all(r.dead_bytes <= r.bytes for r in g)
    new = valuelog.collect(sst.where("fid = 1"), vlog, 9).collect()
    assert {(r.key, r.seq): r.value for r in new} == {(k, s): v for k, s, v in versions if s % 3 == 1}


def test_levels(spark):
    files = [(0, i, 100, a, b) for i, a, b in ((1, "a", "f"), (2, "c", "m"), (3, "x", "z"))] + [(1, 10, 1 << 19, "a", "b"), (1, 11, 1 << 19, "g", "k"), (1, 12, 9, "n", "w"), (2, 20, 1 << 20, "b", "e")]
    f = spark.createDataFrame(files, "level int, id long, size long, smallest string, largest string")
    scores = {r.level: r.score for r in levels.level_scores(f, 4).collect()}
    assert scores == pytest.approx({0: 0.6, 1: ((1 << 20) + 9) / (1 << 20), 2: 0.1, 3: 0.0})
    assert levels.pick_level(f, 4).first().level == 1
    assert levels.pick_level(f.where("level = 0"), 4).first().level == 0
    assert levels.pick_level(f.where("false"), 4).first().level == 0
    deep = spark.createDataFrame([(3, 1, 55 << 20, "a", "b"), (0, 2, 1, "a", "b")], f.schema)
    assert levels.pick_level(deep, 4).first().level == 3
    states = spark.createDataFrame([(1, 1, 1), (2, 1, 3), (2, 2, 1), (3, 1, 1), (3, 2, 2), (20, 1, 1)], "id long, at long, state int")
    assert {(r.id, r.role) for r in levels.inputs_level0(f, states).collect()} == {(1, "base"), (2, "base"), (10, "target"), (11, "target")}
    assert levels.inputs_last_level(f, states, 3).count() == 0  # one file is no work
    spans = [(1, "p", "q"), (2, "fa", "fb"), (3, "zz", "zzz"), (4, "mm", "n"), (5, "mm", "na"), (6, "y", "y")]
    got = {r.rid: r.level for r in levels.flush_level(f, spark.createDataFrame(spans, "rid long, low string, high string"), 7).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: 2, 5: 0, 6: 0}
    assert {(r.a, r.b) for r in levels.overlaps(f).collect()} == {(1, 2)}
    keys = spark.createDataFrame([("d",), ("q",)], "key string")
    assert {(r.key, r.id, r["rank"]) for r in levels.candidate_files(f, keys).collect()} == {("d", 2, 1), ("d", 1, 2), ("d", 20, 3), ("q", 12, 1)}
    mid = levels.inputs_middle(f, spark.createDataFrame([(10, 1, 1), (11, 1, 1)], "id long, at long, state int"), 1, (1, 10, "a", "b"))
    assert mid.count() == 0
    mid = levels.inputs_middle(f, states, 1, (2, 20, "f", "h"))
    assert {(r.id, r.role) for r in mid.collect()} == {(10, "base"), (20, "target")}
    assert levels.inputs_middle(f, states, 1, None).count() == 0


def shuffled(df):
    """The most rows that an exchange of the plan writes, without adaptive execution, which leaves exchanges out where little data is in one partition."""
    conf, rows = df.sparkSession.conf, [0]
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        todo = [again._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.getClass().getSimpleName() == "ShuffleExchangeExec":
                rows.append(node.metrics().apply("shuffleRecordsWritten").value())
    finally:
        conf.unset("spark.sql.adaptive.enabled")
    return max(rows)


def test_candidates_are_not_shuffled(spark, monkeypatch):
    """Every file holds every key: 40 files and 300 keys, in one group or several, and nothing of the size of their pairs is dealt."""
    f = spark.range(40).selectExpr("int(id % 4) level", "id", "1L size", "'a' || lpad(id, 2, '0') smallest", "'y' || id largest")
    keys = spark.range(300).selectExpr("'k' || id key")
    for most in (7, 4096):
        monkeypatch.setattr(levels, "GROUP", most, raising=False)
        out = levels.candidate_files(f, keys)
        rows = out.collect()
        want = [(level, i) for level in range(4) for i in sorted(range(level, 40, 4), reverse=level == 0)]
        assert len(rows) == 300 * 40 and {(r.level, r.id, r["rank"]) for r in rows} == {(*x, n + 1) for n, x in enumerate(want)}
    assert 0 < shuffled(out) < 1000


def test_overlaps_are_not_shuffled(spark, monkeypatch):
    """150 files of a level that all meet, and one of another: each pair once, and nothing of the size of the pairs is dealt."""
    f = spark.range(150).selectExpr("1 level", "id", "1L size", "'a' || id % 50 smallest", "'y' || id largest")
    f = f.unionByName(spark.createDataFrame([(2, 500, 1, "a", "z")], f.schema))
    for size in (7, 1024):
        monkeypatch.setattr(levels, "BLOCK", size, raising=False)
        out = levels.overlaps(f)
        assert sorted(map(tuple, out.collect())) == [(1, a, b) for a in range(150) for b in range(a + 1, 150)]
    assert 0 < shuffled(out) < 1000


def test_gc_planning(spark):
    groups = spark.createDataFrame([(1, 7), (2, 8), (2, 9), (3, 10), (3, 11)], "grp long, vfid long")
    files = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "level int, id long")
    states = spark.createDataFrame([(2, 1, 1)], "id long, at long, state int")
    assert [tuple(r) for r in levels.gc_candidate(groups, files, states).collect()] == [(2, 2)]
    assert levels.gc_candidate(groups, files, states.where("false")).count() == 0
    assert {r.grp: r.logs for r in levels.merge_groups(groups, [1, 3], 9).collect()} == {2: [8, 9], 9: [7, 10, 11]}


def test_manifest(spark):
    rows = [(1, 0, 0, 0, 5, True), (2, 0, 0, 1, 6, True), (2, 1, 1, 0, 5, True), (3, 0, 0, 0, 7, False), (4, 0, 0, 0, 8, True)]
    edits = spark.createDataFrame([(*r[:5], 0, "", "", r[5]) for r in rows], "txn long, pos int, op int, level int, id long, size long, smallest string, largest string, complete boolean")
    assert {(r.level, r.id) for r in manifest.replay(edits).collect()} == {(1, 6)}
    assert manifest.next_file_number(edits, spark.createDataFrame([(4,)], "n int")).first()[0] == 7
    wal = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (2, 0, True)], "fid long, pos long, ok boolean")
    assert {(r.fid, r.pos) for r in manifest.valid_prefix(wal).collect()} == {(1, 0), (2, 0)}


def test_hashes():
    assert int(crc32c_many([b"123456789"])[0]) == 3808858755
    assert crc32c_many([b"", b"a", b"123456789" * 40]).tolist() == [slow_crc(b) for b in (b"", b"a", b"123456789" * 40)]
    items = [b"", b"a", b"ab", b"abc", b"abcd", b"abcde" * 9, bytes(range(256))]
    assert hash32_many(items).tolist() == [slow_hash(b) for b in items]


def slow_crc(data):
    r = 0xFFFFFFFF
    for b in data:
        r ^= b
        for _ in range(8):
            r = (r >> 1) ^ (0x82F63B78 if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def slow_hash(b):
    m, mask = 0xC6A4A793, 0xFFFFFFFF
    h = 0xBC9F1D34 ^ (len(b) * m & mask)
    whole = len(b) // 4 * 4
    for i in range(0, whole, 4):
        h = (h + int.from_bytes(b[i : i + 4], "little")) * m & mask
        h ^= h >> 16
    if len(b) > whole:
        h = (h + int.from_bytes(b[whole:], "little")) * m & mask
        h ^= h >> 24
    return h


def test_bloom(spark, entries, versions):
    keys = sorted({k for k, _, _ in versions})
    f = sketches.build_filter(hash32_many([k.encode() for k in keys]), 10)
    assert f[-1] == 6 and len(f) == 1 + -(-len(keys) * 10 // 8)
    assert sketches.may_contain(f, hash32_many([k.encode() for k in keys])).all()
    assert sketches.may_contain(f, hash32_many([f"no{i}".encode() for i in range(2000)])).mean() < 0.05
    assert not sketches.may_contain(b"\0", hash32_many([b"x"])).any() and sketches.may_contain(b"\0\x1f", hash32_many([b"x"])).all()
    cut = entries.withColumn("fid", F.col("seq") % 2)
    pairs = cut.select("fid", "key").distinct().join(sketches.bloom_filters(cut, "fid", "key", 10), "fid")
    assert all(r.may_contain for r in sketches.probe(pairs, "key", "filter").collect())


def test_count_min(spark):
    rows = [(f"k{i}",) for i in range(40) for _ in range(i % 20)]
    got = {r.key: r.estimate for r in sketches.count_min(spark.createDataFrame(rows, "key string"), "key", 1024).collect()}
    assert all(min(int(k[1:]) % 20, 15) <= e <= 15 for k, e in got.items())
    s = sketches.CountMin(100)
    assert s.mask == 127
    for _ in range(20):
        s.increment(5)
    assert s.estimate(5) == 15
    s.halve()
    assert s.estimate(5) == 7
    s.clear()
    assert s.estimate(5) == 0
    with pytest.raises(ValueError):
        sketches.CountMin(0)


def test_caches(spark):
    rng = random.Random(2)
    rows = [(s, i, f"k{int(rng.paretovariate(0.7)) % 50}") for s in range(2) for i in range(600)]
    df = spark.createDataFrame(rows, "stream long, pos long, key string")
    key = lambda r: (r.stream, r.pos, r.key, r.hit)
    one, two = cachesim.lru_hits(df, 8), cachesim.replay(df, 8, cachesim.LRU)
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))
    for policy in (cachesim.TinyLFU, cachesim.WindowTinyLFU):
        rate = {r.stream: r.rate for r in cachesim.hit_rates(cachesim.replay(df, 8, policy)).collect()}
        assert all(0.2 < v < 1 for v in rate.values())
    cache = cachesim.WindowTinyLFU(100)
    for i in range(5000):
        cache.access(str(i % 700))
        assert len(cache.window) + len(cache.probation) + len(cache.protected) <= 101
    lru = cachesim.LRU(5)
    for k in "01234":
        lru.access(k)
    assert lru.access("1") and not lru.access("6") and not lru.access("0")
    flood = [cachesim.LRU(100), 0]
    assert sum(flood[0].access(str(i % 1000)) for i in range(5000)) == 0


def test_replay_holds_a_batch(spark):
    """No frame in the worker is longer than a batch, and batches don't cut a stream's cache."""

    class Watch(cachesim.LRU):
        def access(self, key):
            import gc

            import pandas

            hit = super().access(key)
            if key == "first" and any(isinstance(x, pandas.DataFrame) and len(x) > 50 for x in gc.get_objects()):
                raise MemoryError("a whole stream is held")
            return hit

    rows = [(s, i, "first" if i == 0 else f"k{i * i % 37}") for s in (0, 1, 2, None) for i in range(400)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "stream long, pos long, key string").repartition(3)
    want = []
    for s in (0, 1, 2, None):
        cache = cachesim.LRU(8)
        want += [(s, i, k, cache.access(k)) for _, i, k in sorted((r for r in rows if r[0] == s), key=lambda r: r[1])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = [tuple(r) for r in cachesim.replay(df, 8, Watch).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_blocks(spark):
    rows = [(1, f"user{i:04d}", i, 6) for i in range(100)] + [(2, "one", 1, 5)]
    out = blocks.layout(spark.createDataFrame(rows, "fid long, key string, seq long, tagged_bytes int"), 256).cache()
    index = {(r.fid, r.block): r for r in blocks.block_index(out).collect()}
    assert sum(r.entries for r in index.values()) == 101 and all(r.bytes <= 256 + 12 for r in index.values())
    assert index[2, 0].base == "one" and index[1, 0].base == "user0000"
    first = out.where("fid = 1 and block = 0").orderBy("offset").collect()
    assert first[0].overlap == 0 and first[1].overlap == 7 and first[1].offset == first[0].bytes == 4 + 8 + 8 + 6
    got = spark.createDataFrame([("abc", "abd"), ("", "x"), ("é", "è"), ("same", "same")], "a string, b string").select(blocks.common_prefix("a", "b")).collect()
    assert [r[0] for r in got] == [2, 0, 1, 4]
    probes = spark.createDataFrame([(1, "user0000"), (1, "a"), (1, "user00055")], "fid long, key string")
    bases = blocks.block_index(out).select("fid", "block", "base")
    found = {r.key: r.block for r in runs.floor_block(bases, probes).collect()}
    assert found["user0000"] == 0 and found["a"] is None and found["user00055"] == 0


def test_group_algebra(spark):
    groups = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "grp long, vfid long")
    assert {tuple(r) for r in levels.drop_groups(groups, [1]).collect()} == {(2, 12)} and levels.drop_groups(groups, []).count() == 3
    moved = levels.move_logs(groups, spark.createDataFrame([(11, 2)], "vfid long, into long"))
    assert {tuple(r) for r in moved.collect()} == {(1, 10), (2, 11), (2, 12)}
    found = levels.group_of(groups, spark.createDataFrame([(12,), (12,), (99,)], "vfid long"))
    assert sorted(map(tuple, found.collect()), key=str) == [(12, 2), (99, None)]


def test_block_sizes(spark):
    rows = spark.createDataFrame([(1, f"k{i:03d}", i, 40) for i in range(60)], "fid long, key string, seq long, tagged_bytes int")
    laid = blocks.layout(rows)
    index = blocks.block_index(laid).orderBy("block").collect()
    assert [r.offset for r in index] == [sum(x.bytes for x in index[:i]) for i in range(len(index))] and len(index) > 2
    assert all(r.bytes <= 1024 for r in index)
    assert [tuple(r) for r in blocks.data_bytes(blocks.block_index(laid)).collect()] == [(1, len(index), 60, sum(r.bytes for r in index) + 16)]


def test_entry_header_and_expiry(spark):
    row = spark.range(1).select(codec.entry_header(F.lit(2), F.lit(300), F.lit(5), F.lit(127)).alias("h"), codec.expires(60, F.lit(1000)).alias("e")).first()
    assert bytes(row.h) == bytes([2, 0xAC, 0x02, 5, 127]) and row.e == 1060
