from collections import Counter

import corpus_pipeline as cp
from stratalog.llm import pieces
from stratalog.llm.common import Scratch
from tests.llm.test_set_join import brute_join


def test_stages_on_documents(spark, sf_dir, docs):
    scratch = Scratch(spark, "t")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "suffix_dedup", "mixture", "tokens"]
    kept = {"": docs}
    for name, stage in cp.STAGES[:-1]:
        before = list(kept.values())[-1]
        kept[name] = scratch.save(stage(spark, before, sf_dir), name)
        assert kept[name].columns == docs.columns
    ids = {n: [r.doc_id for r in df.select("doc_id").collect()] for n, df in kept.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i in ids[""] if labels.get(i) == 1]
    assert set(ids["quality"]) < set(ids[""]) and sum(i in set(ids["quality"]) for i in good) > 0.9 * len(good)
    rows = [(r.doc_id, r.text) for r in kept["quality"].select("doc_id", "text").collect()]
    assert sorted(ids["near_duplicates"]) == sorted({c for _, _, c in brute_join(rows, 5, 80)} | {i for i, n, _ in brute_join(rows, 5, 80) if n == 0})
    texts = {r.doc_id: r.text for r in kept["suffix_dedup"].collect()}
    old = {r.doc_id: r.text for r in kept["near_duplicates"].collect()}
    assert all(len(t) <= len(old[i]) for i, t in texts.items()) and any(t != old[i] for i, t in texts.items())
    seen = Counter(w for t in texts.values() for d in [t.encode()] for w in {d[k : k + 204] for k in range(len(d) - 203)})
    before = Counter(w for t in old.values() for d in [t.encode()] for w in {d[k : k + 204] for k in range(len(d) - 203)})
    assert not [w for w, n in seen.items() if n > 1 and before[w] > 1]
    taken = Counter(ids["mixture"])
    assert set(taken) <= set(texts) and max(taken.values()) <= 3


def test_run_encodes_what_is_left(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    c = pieces.codec(pieces.read_model(cp.MODEL))
    assert rows and all(r.n_tokens == len(r.ids) and c.decode(r.ids) == r.text for r in rows)


def test_odd_rows(spark, odd, sf_dir):
    df = odd
    for name, stage in cp.STAGES:
        out = stage(spark, df, sf_dir)
        assert out.count() >= 0
        if name != "tokens":
            assert out.columns == odd.columns
    assert cp.near_duplicate_stage(spark, odd.where("false"), sf_dir).count() == 0
    assert cp.mixture_stage(spark, odd, sf_dir).where("text is null or text = ''").count() == 0


def test_one_row_of_each_group_survives(spark, sf_dir):
    """Repeated rows, rows without an id and an id with two texts: one copy of each text reaches the end of the suffix stage."""
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(90)) for x in "abcdef")
    rows = [(1, a), (1, a), (1, a)]  # a repeated row
    rows += [(None, b), (None, b), (None, c)]  # two texts without an id
    rows += [(2, d), (7, d), (7, e)]  # of an id's two texts one is a copy of a smaller id's
    rows += [(None, d), (9, e + " more"), (None, f + " more"), (8, f)]  # near copies
    rows += [(3, ""), (3, ""), (3, None), (4, ""), (None, None), (None, None)]  # without a word
    df = spark.createDataFrame([(i, t, "en", str(k % 3)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)
    want = [(1, a), (None, b), (None, c), (2, d), (7, e), (8, f), (3, ""), (3, None), (4, ""), (None, None)]
    near = Scratch(spark, "t").save(cp.near_duplicate_stage(spark, df, sf_dir), "near")
    assert near.columns == df.columns and Counter((r.doc_id, r.text) for r in near.collect()) == Counter(want)
    assert Counter((r.doc_id, r.text) for r in cp.suffix_stage(spark, near, sf_dir).collect()) == Counter(want)
