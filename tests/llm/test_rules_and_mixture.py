import re
from collections import Counter

import pytest

from stratalog.llm import mixture, rules
from stratalog.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def brute_depleted(rows, max_docs, max_share, min_left):
    """rows: distinct (doc_id, text, source)."""
    docs = Counter(host for _, text, host in rows if WORD.search(text or ""))
    norm = lambda x: re.sub(r"[ \t-\r]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    count = Counter()
    for _, text, host in rows:
        count.update({(host, norm(x)) for x in (text or "").split("\n") if WORD.search(x)})
    out = set()
    for row in rows:
        lines = [(len(WORD.findall(x)), count[row[2], norm(x)] > max(max_docs, max_share * docs[row[2]])) for x in (row[1] or "").split("\n")]
        total = sum(n for n, _ in lines)
        if total and total - sum(n for n, bad in lines if bad) < min_left * total:
            out.add(row)
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rules_against_brute_force(spark, which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    limits = {"max_docs": 1, "max_share": 0.05, "min_left": 0.5}
    bad = brute_depleted(set(rows), **limits)
    want = Counter((r[0], *brute_statistics(r[1]), not brute_statistics(r[1])[-1] and r not in bad) for r in rows)
    out = rules.judge(df, Scratch(spark, "t"), **limits)
    got = Counter(tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    assert got == want
    assert which == "odd" or len(bad) > 0


FORMS = ["This notice is shown on every page of the site and says the same thing each time it is seen", "Readers who want to know more about our rules may write to the address that stands below them", "All that was written here belongs to those who wrote it and nobody else may sell any part"]


def test_line_frequency_rejects_against_sql(spark, tmp_path):
    """Documents of lines that their host repeats are rejected, those of their own lines aren't, and one host's lines don't count at another."""
    import duckdb

    from stratalog.llm import queries

    own = lambda i: " ".join("".join(chr(97 + int(c)) for c in str(1000 * k + 60_000 + i)) for k in range(60))
    rows = [(i, f"{FORMS[0]} {i}\n{FORMS[1].upper()} {i}\n{FORMS[2]}\nshort own line {own(i)[:40]}", "en", "a") for i in range(30)]
    rows += [(100 + i, f"{FORMS[i % 3]}{f' {i}' * (i % 3 < 2)}\n{own(i)}", "en", "a") for i in range(900)]  # half is their own, and more
    rows += [(2000 + i, rows[i][1], "en", "b") for i in range(3)]  # too few documents of this host
    rows += [(3000, None, None, None), (3001, "", "en", None)]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = queries.op8_quality_rules(spark, f"file://{tmp_path}")
    got = sorted(tuple(r) for r in out.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(queries.oracle_sql()["op8_quality_rules"])
    names = [c[0] for c in cur.description]
    assert sorted(tuple(r[names.index(c)] for c in out.columns) for r in cur.fetchall()) == got
    assert not any(r[6] for r in got if r[0] < 3000)  # none fails the base rules: the lines decide
    assert {r[0] for r in got if not r[7]} == {*range(30), 3000, 3001}


def test_line_frequency_fires_on_documents(spark):
    """Of the documents of sf0.1 that pass the base rules, line frequency rejects some."""
    out = rules.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), Scratch(spark, "t"))
    assert 0 < out.where("not base_failed and not kept").count() < 100


def test_no_false_repeat_in_a_long_text(spark):
    """Among a million different windows those at 75,405 and 1,050,346 have equal low 43 bits of their hashes."""
    words = [f"k{i}" for i in range(1_060_000)]
    df = spark.createDataFrame([(1, " ".join(words), "h"), (2, " ".join(words + words[70_000:70_005]), "h")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.n_words, r.n_repeat_words) for r in rules.statistics(df).collect()} == {1: (1_060_000, 0), 2: (1_060_005, 10)}


def test_strip_lines(spark):
    df = spark.createDataFrame([(i, f"Page {i}\nown line {chr(97 + i)}", "h") for i in range(5)], "doc_id long, text string, source string")
    out = rules.strip_lines(df, Scratch(spark, "t"), max_docs=3, max_share=0.5)
    assert {r.text for r in out.collect()} == {f"own line {chr(97 + i)}" for i in range(5)}


def brute_targets(sizes, cap=3.0):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    return target


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixture(spark, which, request):
    df = request.getfixturevalue(which)
    rows = mixture.mix(df, Scratch(spark, "t")).collect()
    again = mixture.mix(df.repartition(3), Scratch(spark, "t")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, str(r.source), r.copies)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    texts = df.select("doc_id", "text", "source").collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in texts)
    sizes = Counter()
    for r in texts:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(dict(sizes))
    for s, total in sizes.items():
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == total and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.copies * r.size for r in own) - want[s]) <= max(r.size for r in own) + 1e-6
        assert all(0 <= r.copies <= 3 for r in own)
    assert key(rows[0])


def test_targets_cascade(spark):
    sizes = {"a": 1, "b": 2, "c": 400, "d": 30, None: 5, "e": 0}
    got = mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_expectations_are_kept(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 4 else "b") for i in range(120)], "doc_id long, text string, source string")
    taken = Counter()
    for seed in range(6):
        for r in mixture.mix(df, Scratch(spark, "t"), seed=seed).collect():
            taken[r.source] += r.copies
    share = {r.source: r.target / r.source_size for r in mixture.mix(df, Scratch(spark, "t")).collect()}
    for s, n in (("a", 90), ("b", 30)):
        assert taken[s] / 6 == pytest.approx(n * share[s], rel=0.1)


def test_empty(spark, docs):
    none = docs.where("false")
    assert mixture.mix(none, Scratch(spark, "t")).count() == 0
    assert rules.judge(none, Scratch(spark, "t")).count() == 0
