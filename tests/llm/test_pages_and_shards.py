import html
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import pieces, queries, style_tree, token_shards
from stratalog.llm.common import Scratch


def test_main_text_of_messy_markup():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
    <nav><ul><li><a href="/x">menu</a></ul></nav><div class="ad">buy</div><!-- <p>no</p> -->
    <article><header><h1>Head &amp; <i>tail</i>&nbsp;x</h1></header><p><b>One<br>two <p>three &lt;b&gt;
      four<ul><li>a<li>b</ul><aside>no</aside><form>no<input></form><div id="user-comments"><p>no</p></div>loose</article>
    <p>outside</p><footer>no</footer></body></html>"""
    assert style_tree.main_text(page, set()) == "Head & tail x\nOne two\nthree <b> four\na\nb\nloose"
    assert style_tree.main_text("", set()) == "" and style_tree.main_text("just text", set()) == "just text"
    assert style_tree.main_text("<p>unclosed <b a='x>y", set()).startswith("unclosed")
    assert style_tree.main_text('<p class="a>b">in</p>', set()) == "in"


@pytest.mark.parametrize(
    "page",
    [
        '<html class="no-ads"><body><article><p>One</p></article></body></html>',
        '<body class="has-sidebar"><div class="sidebar">menu</div><article><p>One</p></article></body>',
        '<body class="no-ads"><nav>menu</nav><p>One</p></body>',
        '<main class="with-sidebar"><p>One</p></main>',
        '<main class="with-sidebar"><div class="left sidebar_off"><article><p>One</p></article></div></main>',
        '<article class="post comment-open"><p>One</p><div id="comments"><p>no</p></div></article>',
        '<div id="search-page"><article><p>One</p></article></div><div class="ad">buy</div>',
        '<div id="search-page"><div class="share">no</div><p>One</p></div>',
        '<div class="no-header"><div class="promo-off"><main><p>One</p></main></div></div>',
        '<span class="no-ads"><article><p>One</p></article></span>',
        '<article><p>One</p><div id="comments"><article class="comment"><p>no</p></article></div></article>',
    ],
)
def test_names_of_what_holds_the_text(page):
    assert style_tree.main_text(page.replace("One", "One two three four five"), set()) == "One two three four five"


def test_only_named_branches():
    page = "".join(f'<div class="text-widget"><p>part {i}</p></div>' for i in range(5))
    assert style_tree.main_text(page, set()) == "\n".join(f"part {i}" for i in range(5))


def test_entropy_confirms_large_named_branches(spark):
    """A box with half of the text that all pages share goes; one that differs stays, and with it what its body's names would have cost."""
    same = "<div class='cookie-notice'><p>" + "the same long notice " * 9 + "</p></div>"
    rows = [(i, f"http://a.com/{i}", f"<body class='has-sidebar'>{same}<p>text number {i}</p></body>") for i in range(8)]
    rows += [(20 + i, f"http://b.com/{i}", f"<body><div id='search-page'><p>text number {i}</p></div></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(df, Scratch(spark, "t")).collect()}
    assert got == {r[0]: f"text number {r[0] % 20}" for r in rows}


def test_pages_without_declared_parts(spark):
    """Neither elements nor names say what is what: the tree tells menus and notices, which the host repeats, from texts."""
    rows = [(i, f"http://a.com/{i}", f"<body><div><a>menu {i % 3}</a> <a>more</a></div><div><p>text {i} of its own</p><p>and {i * 7}</p></div><div>notice {i % 2}</div><div>all rights</div></body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(df, Scratch(spark, "t")).collect()}
    assert got == {i: f"text {i} of its own\nand {i * 7}" for i in range(40)}
    nodes = style_tree.importances(style_tree.style_rows(df.select(style_tree.host_of().alias("host"), "html")))
    by = {r.path: r for r in nodes.collect()}
    assert by["/body/div:1"].importance < by["/body/div:2/p"].importance and by["/body/div:3"].seen < by["/body/div:1"].seen < 0.4


def test_names_inside_an_article_are_a_prior_only(spark):
    """On a host of many pages a branch of an article whose texts differ stays, whatever it is called; comments go."""
    box = "<article><p>text {0}</p><div class='share-notice search'><p>block {0}</p></div><div class='ad'><p>buy</p></div><div id='comments'><p>said {0}</p></div></article><nav>menu {0}</nav>"
    df = spark.createDataFrame([(i, f"http://a.com/{i}", box.format(i)) for i in range(80)] + [(99, "http://b.com/", box.format(99))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(df, Scratch(spark, "t")).collect()}
    assert got == {i: f"text {i}\nblock {i}" for i in range(80)} | {99: "text 99"}


def test_odd_pages(spark):
    """Nulls, a very large page, a url without a host, equal rows and columns of the result's names."""
    long = "<article>" + "".join(f"<p>word {i} &amp; more</p>" for i in range(40_000)) + "</article>"
    rows = [(None, None, None, 1, "x"), (1, "no host", long, 2, "x"), (1, "no host", long, 2, "x"), (2, "http://a.com", "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in style_tree.extract(df, Scratch(spark, "t")).collect()))
    want = "\n".join(f"word {i} & more" for i in range(40_000))
    assert got == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0)]


def test_unclosed_quotes_take_linear_time():
    assert isinstance(style_tree.main_text("<a '" * 20_000, set()), str)


def test_pages(spark, sf_dir):
    """The generated pages: the article's blocks."""
    import re

    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in style_tree.extract(df, Scratch(spark, "t")).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_repeated_branches_go(spark):
    """Undeclared boxes that a host's pages share go; what differs stays; a host's only page keeps all."""
    rows = [(i, f"http://a.com/{i}", f"<body><div class='x1'>Same on all</div><div class='x2'><p>text number {i}</p></div></body>") for i in range(8)]
    rows += [(20, "http://b.com/1", rows[0][2]), (21, None, None), (22, "http://a.com/e", "")]
    rows += [(30 + i, "http://c.com/", "<article><h1>Copy</h1><p>all pages alike</p></article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(df, Scratch(spark, "t")).collect()}
    assert all(got[i] == f"text number {i}" for i in range(8))
    assert got[20] == "Same on all\ntext number 0" and got[21] == got[22] == ""
    assert all(got[30 + i] == "Copy\nall pages alike" for i in range(9))
    assert style_tree.extract(df.where("false"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    p = token_shards.Permutation(n, 99)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert p.index(slots).tolist() == list(range(n))
    assert n < 64 or (slots != token_shards.Permutation(n, 98).slot(np.arange(n))).any()


def test_shards_round_trip(spark, docs, tmp_path):
    layout = token_shards.write(docs, f"file://{tmp_path}/a", length=64, per_shard=1000)
    assert token_shards.open_layout(spark, layout.path) == layout
    rows = token_shards.read(spark, layout).collect()
    assert sorted(r.slot for r in rows) == list(range(layout.sequences))
    texts = {r.doc_id: r.text.encode() for r in docs.select("doc_id", "text").collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.seq_no] = bytes(r.ids)
    assert {d: b"".join(s[k] for k in sorted(s)) for d, s in by.items()} == {d: t for d, t in texts.items() if t}
    files = [f for f in (tmp_path / "a/shards").rglob("part-*") if f.is_file()]
    sizes = sorted(os.path.getsize(f) for f in files)
    assert len(files) == layout.shards and all(s == 1000 * layout.stride for s in sizes[1:])
    assert not os.path.exists(tmp_path / "a/staging")
    late = token_shards.read(spark, layout, from_slot=layout.sequences - 1500).collect()
    assert sorted(r.slot for r in late) == list(range(layout.sequences - 1500, layout.sequences))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot)]
    assert order != sorted(order)


def mixed(x):
    """The finaliser of the permutation's rounds, on Python integers."""
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 % (1 << 64)
    return x ^ (x >> 32)


def slot_by_hand(index, n, key):
    half = max(1, -(-(n - 1).bit_length() // 2))
    while True:
        left, right = index >> half, index % (1 << half)
        for r in range(token_shards.ROUNDS):
            left, right = right, left ^ (mixed(right ^ mixed(key * 64 + r)) % (1 << half))
        index = (left << half) | right
        if index < n:
            return index


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_documents_slots(spark, docs, tmp_path, rounds):
    """Slots and contents against a permutation worked out number by number."""
    one = docs.select("doc_id", "text").orderBy("doc_id").coalesce(1)
    layout = token_shards.write(one, f"file://{tmp_path}/e", length=100, per_shard=700, key=5, rounds=rounds)
    want, index = {}, 0
    texts = [(r.doc_id, (r.text or "").encode()) for r in one.collect()]
    total = sum(-(-len(t) // 100) for _, t in texts)
    for doc, text in texts:
        for k in range(-(-len(text) // 100)):
            want[slot_by_hand(index, total, 5)] = (doc, k, text[100 * k : 100 * k + 100])
            index += 1
    assert len(want) == total == layout.sequences
    assert {r.slot: (r.doc_id, r.seq_no, bytes(r.ids)) for r in token_shards.read(spark, layout).collect()} == want


def test_a_source_that_changes_has_one_numbering(spark, tmp_path):
    """Texts are read once, so other texts and partitions at every reading do no harm."""
    import uuid

    fresh = F.udf(lambda i: uuid.uuid4().hex * (uuid.uuid4().int % 9)).asNondeterministic()
    layout = token_shards.write(spark.range(300).repartition(7).select(F.col("id").alias("doc_id"), fresh("id").alias("text")), f"file://{tmp_path}/f", length=16, per_shard=64)
    rows = token_shards.read(spark, layout).collect()
    assert sorted(r.slot for r in rows) == list(range(layout.sequences)) and layout.sequences > 300
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.seq_no] = bytes(r.ids)
    assert all(sorted(s) == list(range(len(s))) and len({s[k] for k in s if k % 2 == 0}) == 1 for s in by.values())


def test_gaps_in_the_numbering_fail(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 2)], "part long, place long")
    with pytest.raises(ValueError, match="partition 1"):
        token_shards.first_numbers(rows)
    assert token_shards.first_numbers(rows.where("part = 0")) == ({0: 0}, 2)


def test_wide_ids_and_odd_rows(spark, odd, tmp_path):
    def pack(texts):
        return [np.frombuffer(t, np.uint8).astype("<u2").tobytes() for t in texts]

    layout = token_shards.write(odd, f"file://{tmp_path}/b", pack, width=2, length=100, per_shard=7)
    rows = token_shards.read(spark, layout).collect()
    want = sum(-(-len((r.text or "").encode()) // 100) for r in odd.collect())
    assert len(rows) == layout.sequences == want
    assert any(r.doc_id is None for r in rows) and all(len(r.ids) == 2 * r.n_tokens for r in rows)
    empty = token_shards.write(odd.where("text is null"), f"file://{tmp_path}/c")
    assert empty.sequences == 0 and token_shards.read(spark, empty).count() == 0


def test_rank_ids(spark, docs, tmp_path):
    ranks = pieces.read_model(f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    layout = token_shards.write(docs, f"file://{tmp_path}/d", token_shards.rank_ids(ranks), width=2, length=256)
    by: dict = {}
    for r in token_shards.read(spark, layout).collect():
        by.setdefault(r.doc_id, {})[r.seq_no] = bytes(r.ids)
    decode = token_shards.ranked(ranks, token_shards.PATTERN).decode
    got = {d: decode(np.frombuffer(b"".join(s[k] for k in sorted(s)), "<u2").tolist()) for d, s in by.items()}
    assert got == {r.doc_id: r.text for r in docs.collect() if r.text}
