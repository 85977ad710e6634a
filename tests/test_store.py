import os
import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import codec
from stratalog.model import ChecksumMismatch, EmptyKey, KeyNotFound, Options
from stratalog.sources import binary
from stratalog.sources.store import Store
from stratalog.streaming import upserts


def batch(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, n long")


@pytest.mark.parametrize("ordering", ["bytes", "integer"])
def test_set_flush_compact_get(spark, tmp_path, ordering):
    store = Store(spark, f"file://{tmp_path}/s", Options(ordering=ordering))
    with pytest.raises(EmptyKey):
        store.set("", "x")
    want = {}
    for r in range(3):
        rows = [(str(j), f"{j + 100 * r}", j) for j in range(0, 60)]
        store.put(batch(spark, rows), [F.col("n")])
        want.update({k: v for k, v, _ in rows})
        assert store.flush()
    assert store.flush() is None
    store.set("7", None)
    want["7"] = None
    again = Store(spark, f"file://{tmp_path}/s", Options(ordering=ordering))
    assert {k: again.get(k) for k in ("0", "7", "59", "nope")} == {"0": "200", "7": None, "59": "259", "nope": None}
    assert {r.key: r.value for r in again.scan().collect()} == want
    assert [r.key for r in again.scan("10", "12").collect()] == ["10", "11", "12"]
    assert again.get_as_of("5", 6) == "5" and again.get_as_of("5", 66) == "105"
    with pytest.raises(KeyNotFound):
        again.get_as_of("5", 1)
    made = again.compact()
    left = [r for r in again.live() if r["level"] >= 0]
    assert set(made) <= {r["id"] for r in left} and len(left) < 3
    assert {r.key: r.value for r in again.scan().collect()} == want
    assert again.next_seq() == 182


def test_separation_compaction_collection_recovery(spark, tmp_path):
    """2,000 keys, small values and then large ones: values apart in files of bounded size, and the same answers all along."""
    options = Options(table_size=16384)
    store = Store(spark, f"file://{tmp_path}/s", options)
    for text in ("{0}", "abcdefghijklmn{0}", "opqrstuvwxyzab{0}"):
        rows = [(str(i), text.format(i), i) for i in range(2000)]
        store.put(batch(spark, rows), [F.col("n")])
        assert store.flush()
    want = {str(i): f"opqrstuvwxyzab{i}" for i in range(2000)}
    levels = [r["level"] for r in store.live()]
    assert levels.count(-2) > 2 and len([x for x in levels if x >= 0]) > 3 and store.next_seq() == 6001
    assert {r.key: r.value for r in store.scan().collect()} == want and store.get_as_of("7", 8) == "7" and store.get_as_of("77", 2078) == "abcdefghijklmn77"
    made = store.compact()
    assert made
    assert {r.key: r.value for r in store.scan().collect()} == want
    again = Store(spark, store.path, options)
    turns = 0
    while again.collect() is not None and turns < 9:
        turns += 1
    live = [r for r in again.live()]
    pointed = {r[0] for r in again.sorted_entries(r["id"] for r in live if r["level"] >= 0).where("tag = 2").select("vfid").distinct().collect()}
    assert pointed == {r["id"] for r in live if r["level"] == -2}  # what nothing points into is gone
    assert again.vacuum() and {r.key: r.value for r in again.scan().collect()} == want and again.get("1999") == want["1999"] and again.get("x") is None


def test_recovery_of_commit_logs(spark, tmp_path):
    """5,000 entries in a commit log: all there after recovery, the numbers go on, and damage ends a log or raises."""
    (tmp_path / "w").mkdir()
    data = [binary.wal_record(str(i).encode(), i + 1, f"v{i}".encode()) for i in range(5000)]
    (tmp_path / "w/00001.wal").write_bytes(b"".join(data[:3000]))
    (tmp_path / "w/00002.wal").write_bytes(b"".join(data[3000:]))
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.recover(f"file://{tmp_path}/w", strict=True) == 5000 and store.recover(f"file://{tmp_path}/w") == 0
    store.set("1111", "new")
    assert store.next_seq() == 5002
    again = Store(spark, store.path)
    assert again.flush()
    assert {r.key: r.value for r in again.scan().collect()} == {str(i): "new" if i == 1111 else f"v{i}" for i in range(5000)}
    bad = bytearray(b"".join(data[:9]))
    bad[len(data[0]) * 5] ^= 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d/00001.wal").write_bytes(bytes(bad))
    damaged = Store(spark, f"file://{tmp_path}/t")
    with pytest.raises(Exception, match="damaged"):
        damaged.recover(f"file://{tmp_path}/d", strict=True)
    assert 0 < damaged.recover(f"file://{tmp_path}/d") < 9
    with pytest.raises(ChecksumMismatch):
        list(binary.wal_records(bytes(bad), strict=True))
    with pytest.raises(ChecksumMismatch):
        list(binary.value_records(binary.value_record(b"k", b"v")[:-1], strict=True))


def test_incomplete_transactions_are_not_seen(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.set("a", "1")
    spark.createDataFrame([(9, 0, 0, 0, 77, 1, "a", "b", False)], "txn long, pos int, op int, level int, id long, size long, smallest string, largest string, complete boolean").write.mode("append").parquet(f"{store.path}/manifest")
    assert store.get("a") == "1" and 77 not in {r["id"] for r in store.live()}


def test_streams(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    for i in range(3):
        spark.createDataFrame([(f"k{j}", f"{i}-{j}") for j in range(5)], "key string, value string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/s")
    q = upserts.into_store(stream, store, lambda: [F.col("key")], f"file://{tmp_path}/c", flush_every=2)
    q.awaitTermination()
    assert q.exception() is None
    assert store.next_seq() == 16 and {r.key for r in store.scan().collect()} == {f"k{j}" for j in range(5)}


def test_binary_logs(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(9)}".encode(), i, os.urandom(rng.randrange(60))) for i in range(200)]
    data = b"".join(binary.wal_record(*r) for r in rows)
    assert [(k, s, v) for _, k, s, v in binary.wal_records(data)] == rows
    assert len(list(binary.wal_records(data[:-1]))) == 199
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 255
    assert 0 < len(list(binary.wal_records(bytes(damaged)))) < 200
    (tmp_path / "00003.wal").write_bytes(data)
    (tmp_path / "00004.wal").write_bytes(b"")
    (tmp_path / "00005.vlog").write_bytes(b"".join(binary.value_record(k, v) for k, _, v in rows))
    got = binary.read(spark, f"file://{tmp_path}", "wal").collect()
    assert [(bytes(r.key), r.seq, bytes(r.value)) for r in sorted(got, key=lambda r: r.pos)] == rows and {r.fid for r in got} == {3}
    got = binary.read(spark, f"file://{tmp_path}", "vlog").collect()
    assert [(bytes(r.key), bytes(r.value)) for r in sorted(got, key=lambda r: r.pos)] == [(k, v) for k, _, v in rows]
    sizes = spark.createDataFrame([(k, v) for k, _, v in rows], "key binary, value binary").select(F.sum(codec.value_log_record_size("key", "value")), F.sum(codec.wal_record_size("key", "value"))).first()
    assert tuple(sizes) == (os.path.getsize(tmp_path / "00005.vlog"), len(data))


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**32 - 1, 2**56 - 1, 2**63 - 1]
    t = spark.createDataFrame([(n, f"key{n}") for n in numbers], "n long, k string")
    v = codec.varint("n")
    for r in t.select("n", v.alias("v"), codec.varint_length("n").alias("l"), codec.read_varint(v).alias("back"), codec.from_big_endian(codec.big_endian("n")).alias("be")).collect():
        assert bytes(r.v) == binary.varint(r.n) and r.l == len(r.v) == r.back.size and r.back.value == r.n == int(r.be)
    out = t.where("n < 72057594037927936").select(
        "n",
        "k",
        codec.parse_internal_key(codec.internal_key(F.encode("k", "UTF-8"), "n")).alias("a"),
        codec.read_tagged(codec.tag_pointer("n", F.lit(77))).alias("p"),
        codec.read_tagged(codec.tag_inline(F.encode("k", "UTF-8"))).alias("i"),
        codec.read_value_struct(codec.value_struct(F.lit(2), "n", F.encode("k", "UTF-8"))).alias("v"),
        codec.split_newest_first(codec.newest_first_key(F.encode("k", "UTF-8"), "n")).alias("t"),
        codec.read_length_prefixed(codec.length_prefixed(F.encode("k", "UTF-8"))).alias("lp"),
        codec.next_power_of_2("n").alias("np"),
    )
    for r in out.collect():
        k = r.k.encode()
        assert (bytes(r.a.key), r.a.seq) == (k, r.n) and (r.p.tag, r.p.fid, r.p.pos, r.p.inline) == (2, r.n, 77, None)
        assert (r.i.tag, bytes(r.i.inline)) == (1, k) and (r.v.meta, r.v.expires_at, bytes(r.v.value)) == (2, r.n, k)
        assert (bytes(r.t.key), r.t.ts) == (k, r.n) and bytes(r.lp) == k
        assert r.np == (r.n if r.n <= 1 else 1 << (r.n - 1).bit_length())
    names = spark.createDataFrame([("00012.sst",), ("x/123456.sst",), ("a.sst",), ("00012.wal",)], "f string")
    assert [r[0] for r in names.select(codec.file_number("f", "sst")).collect()] == [12, 123456, 0, 0]
