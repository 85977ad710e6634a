import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import set_join
from stratalog.llm.common import Scratch, components, marked
from stratalog.llm.shingles import WordHasher, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_join(rows, size, percent):
    sets = [(i, brute_set(t, size)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if a is None or b is None or not s or not t or min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                continue
            if 100 * len(s & t) >= percent * len(s | t):
                parent[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[root(i)] = min(least.get(root(i), a), a)
    # equal ids are one document in the result's eyes
    return sorted(((a, len(s), least.get(root(i)) if a is not None else None) for i, (a, s) in enumerate(sets)), key=str)


def result(df, spark, size, percent):
    return sorted(map(tuple, set_join.join(df, Scratch(spark, "t"), size, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_documents(spark, docs, size, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_join(rows, size, percent)
    assert result(docs, spark, size, percent) == want
    assert any(a != c for a, _, c in want)


def near_copies(seed, groups=14, each=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 6, 8, 12, 30, 90, 250]))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(w) // 25))):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"w{rng.randrange(400)}"] * rng.randrange(2)
            if rng.random() < 0.2:
                w = base[: len(base) // 2] + [f"v{rng.randrange(9999)}" for _ in range(rng.randrange(40))]
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, spark, 4, 85) == brute_join(rows, 4, 85)


def test_chain_and_large_group(spark):
    """A chain whose ends aren't linked, and a group larger than any bucket should expand."""
    words = [f"a{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 7 : i * 7 + 100])) for i in range(20)]
    copies = [(1000 + i, "one two three four five six seven eight nine ten") for i in range(500)]
    rows = chain + copies
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), spark, 4, 85)
    assert got == sorted([(i, 97, 0) for i, _ in chain] + [(i, 7, 1000) for i, _ in copies], key=str)


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(odd, spark, 4, 85) == brute_join(rows, 4, 85)
    assert result(odd.where("false"), spark, 4, 85) == []


def test_bands_hold_all_pairs():
    for percent in (80, 85, 95):
        bands = set_join.Bands(percent).upto(3000)
        lows = [b.low for b in bands]
        for a in (1, 2, 3, 7, 10, 33, 100, 501, 1999):
            for b in {a, 100 * a // percent, (a + 100 * a // percent) // 2}:
                ka, kb = (int(np.searchsorted(lows, x, side="right")) - 1 for x in (a, b))
                assert kb - ka in (0, 1)
                assert set_join.most_errors(a + b, percent) <= bands[ka].errors
    kinds = {b.deletions for b in set_join.Bands(85).upto(3000)}
    assert kinds == {True, False}


def test_hashed_sets_are_exact():
    texts = ["", "a", "A b", "a b c d e", "x " * 50, "  lead and\ttail \n", "É é", "one\x0btwo\x1cthree", "y" * 300_000 + " z"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    words, row = WordHasher()(np.frombuffer(b"".join(data), np.uint8), offsets)
    owner, token = shingle_sets(words, row, len(texts), 4)
    for i, t in enumerate(texts):
        assert (owner == i).sum() == len(brute_set(t, 4))
    assert len(np.unique(token)) == len(frozenset().union(*(brute_set(t, 4) for t in texts)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (5, 5)]
    got = dict(map(tuple, components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}


def test_words_that_fool_a_polynomial(spark):
    """The Thue-Morse word over a and b and its complement collide modulo 2**64 in any base; here they aren't linked."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 12))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, other.upper())], "doc_id long, text string")
    assert result(df, spark, 4, 85) == [(1, 1, 1), (2, 1, 2), (3, 1, 2)]


def test_exact_overlap():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (" ".join(rng.choice("aBbc") for _ in range(rng.randrange(9))) for _ in range(2))
        s, t = brute_set(a, 4), brute_set(b, 4)
        assert set_join.exact_overlap(a.encode(), b.encode(), 4) == (len(s), len(t), len(s & t))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_form_letters_in_blocks(spark, monkeypatch, block):
    """Letters of 50 shared and 30 own words share signatures and aren't linked; near copies among them are. No cell holds more than two blocks."""
    monkeypatch.setattr(set_join, "BLOCK", block)
    rng = random.Random(5)
    form = [f"form{i}" for i in range(50)]
    rows = [(i, " ".join(form + [f"w{rng.randrange(10**6)}" for _ in range(30)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, spark, 4, 85) == brute_join(rows, 4, 85)
    placed = spark.createDataFrame([(1, c, c % 5) for c in range(40)] + [(2, 7, 1), (2, 8, 1)], "sig long, cls long, comp long")
    cells = set_join.block_cells(placed).collect()
    assert {r.sig for r in cells} == {1}
    met = {(a.cls, b.cls) for a in cells for b in cells if (a.one, a.two) == (b.one, b.two) and a.cls < b.cls and (a.one == a.two or a.block != b.block)}
    assert met == {(a, b) for a in range(40) for b in range(a + 1, 40)}


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    """80 letters that miss the threshold by two shingles: a sketch can't reject their 3,160 pairs, their whole sets do. Links among them are found, also where no head led to them."""
    form = [f"form{i}" for i in range(100)]
    rows = [(i, " ".join(form + [f"own{i}x{k}" for k in range(9)])) for i in range(80)]
    rows += [(100 + i, rows[i][1] + f" end{i}") for i in range(0, 80, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, verify = [], set_join.verify

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(set_join, "CROWD", 16, raising=False)
    monkeypatch.setattr(set_join, "verify", counted)
    want = brute_join(rows, 4, 85)
    assert result(df, spark, 4, 85) == want and len({c for *_, c in want}) == 80
    assert len(made) == 3 and sum(made) < 3 * len(rows)
    made.clear()
    monkeypatch.setattr(set_join, "verify", lambda pairs, *rest: counted(pairs, *rest).limit(0 if len(made) == 1 else 1 << 30))
    assert result(df, spark, 4, 85) == want and len(made) == 3 and made[1] >= 9


def test_marked_keys_are_never_missed(spark):
    df = spark.range(20_000).selectExpr("id", "cast(null as int) x", "'s' _other")
    out = marked(df, F.col("id"), spark.range(0, 20_000, 7).withColumnRenamed("id", "k"), F.col("k"))
    assert out.columns == [*df.columns, "_maybe"] and out.where("_maybe and id % 7 = 0").count() == 2858
    assert out.where("_maybe").count() < 2900 and marked(df, F.col("id"), spark.range(0), F.col("id")).where("_maybe").count() == 0


def test_small_buckets_are_listed_and_copies_make_none(spark, monkeypatch):
    """Eight letters share signatures and aren't linked: their pairs are listed, and no bucket is dealt. Copies of one class are no bucket."""
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (2, 6), (3, 7)], "sig long, cls long")
    assert {(r.sig, r.cls) for r in set_join.live_buckets(rows).collect()} == {(2, 5), (2, 6)}
    form = [f"form{i}" for i in range(100)]
    rows = [(i, " ".join(form + [f"own{i}x{k}" for k in range(9)])) for i in range(7)]
    rows += [(10, rows[3][1] + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, bucket_pairs = [], set_join.bucket_pairs

    def counted(cells, *rest):
        dealt.append(cells.count())
        return bucket_pairs(cells, *rest)

    monkeypatch.setattr(set_join, "bucket_pairs", counted)
    assert result(df, spark, 4, 85) == brute_join(rows, 4, 85)
    assert dealt and not any(dealt)
