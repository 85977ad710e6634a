import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import suffix_dedup, suffixes
from stratalog.llm.common import Scratch


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, df, length, gram):
    rows = df.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], length)))
    out = suffix_dedup.dedup(df, Scratch(spark, "t"), length=length, gram=gram)
    assert Counter(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want
    return want


def test_documents(spark, docs):
    want = check(spark, docs, 200, 64)
    assert sum(k[2] for k in want) > 0


@pytest.mark.parametrize("seed, crowd", [(1, 256), (2, 1), (3, 4)])
def test_shared_passages(spark, seed, crowd, monkeypatch):
    """With small crowds the cells of common anchors are cut again, as deep as it goes."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passages = [word(rng.choice([15, 20, 21, 40, 70])) for _ in range(8)]
    texts = ["".join(rng.choice([word(rng.randrange(30)), rng.choice(passages), rng.choice(passages)[3:]]) for _ in range(rng.randrange(7))) for _ in range(60)]
    texts += ["x" * 100, "x" * 50, "ab" * 40, "\0" * 60, None, ""]
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20, 6)


def test_a_passage_in_many_texts_is_split(spark):
    """One passage with other words around it: what crowds an anchor is dealt to other shards, and the result is exact."""
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = own(260)
    texts = [own(rng.randrange(150, 200)) + passage + own(rng.randrange(150, 200)) for _ in range(400)]
    texts += [own(100) + passage[:-1] + "#" + own(50), own(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(spark, df, 200, 64)
    rows = df.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("tail"), F.encode("text", "UTF-8").alias("text"))
    crowd = lambda depth: suffix_dedup.shared_cells(suffix_dedup.cell_rows(rows, 200, 64, True, depth)).where("shown").groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert crowd(0) > 256


def test_stretches_of_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 97)
    long_ = ["".join(rng.choice("ab") for _ in range(700)) for _ in range(4)]
    long_.append(long_[0][100:400] + long_[1][:350])
    cutter = suffix_dedup.CellCutter(20, 6)
    for t in long_:
        _, _, low, high, _ = cutter.cells(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert sorted(x for a, b in zip(low, high) for x in range(a, b + 1)) == list(range(len(t) - 19))


def test_odd_rows(spark, odd):
    check(spark, odd, 200, 64)
    none = suffix_dedup.dedup(odd.where("false"), Scratch(spark, "t"), with_text=True)
    assert none.count() == 0 and {"n", "ids", "score"} <= set(none.columns)


def test_kept_text_has_whole_characters(spark):
    rng = random.Random(5)
    same = "é".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(1, "ê" + same + "tail one"), (2, "è" + same + "no end")]
    out = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), with_text=True).collect()}
    assert out[1].kept_text == "êtail one" and out[2].kept_text == "èno end"
    assert all(r.n_removed > len(same.encode()) - 1 and r.n_spans == 1 for r in out.values())


@pytest.mark.parametrize("symbols", [1, 2, 4, 200])
def test_suffix_array(symbols, monkeypatch):
    rng = np.random.default_rng(symbols)
    for small in (0, 1024):
        monkeypatch.setattr(suffixes, "SMALL_ALPHABET", small)
        for n in (0, 1, 2, 3, 10, 300):
            t = rng.integers(0, symbols, n)
            if n == 300:
                t[150:] = t[:150]
            want = sorted(range(n), key=lambda i: tuple(t[i:]))
            assert suffixes.suffix_array(t, symbols).tolist() == want


def test_many_names_are_not_sorted_suffix_by_suffix(monkeypatch):
    """Shards have some hundred thousand names; a Python step for each was half of the query's time in the arrays."""
    monkeypatch.setattr(suffixes, "induce_by_suffix", None)
    rng = np.random.default_rng(7)
    t = rng.integers(1, 100, 20_000)
    t[12_000:] = t[:8_000]
    t[8_000:9_000], t[9_000:9_400] = 5, np.tile([3, 9], 200)
    raw = t.astype(np.uint8).tobytes()
    assert suffixes.suffix_array(t, 256).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_common_prefixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[200:300] = data[50:150]
    sa = suffixes.suffix_array(data, 256)
    room = np.arange(400, 0, -1)
    got = suffixes.common_prefixes(data, room, sa)
    raw = data.tobytes()
    for a, b in zip(sa[:-1], sa[1:]):
        n = 0
        while max(a, b) + n < 400 and raw[a + n] == raw[b + n]:
            n += 1
        assert got[b] == n
    assert got[sa[0]] == 0
