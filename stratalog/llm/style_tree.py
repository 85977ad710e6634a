"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of element paths (tag, class, id, and the
place among the unlabelled containers of a parent; inline elements aside).  A node's
presentation importance is the entropy of its sequences of children over the pages that
have it, less its share of link text; its content importance is the entropy of its
texts; both to the base of the number of pages, 0 where all pages agree, 1 where each
has its own.  A node's importance is composed of both and judged against its host: what
lies under a share of the importance of the host's best node that half of the pages
have is removed, branch by branch.

On few pages entropy says little, so it is mixed with a prior that counts as ``PRIOR``
pages: 0 for what markup declares to be something else than content (elements, roles,
class and id words for menus, footers, adverts, comments, forms, and all outside a
declared article or main part), else 1.  The more pages a host has, the less the prior
says.  Menus and adverts that differ on every page can't be told from an article by
entropy; what the tree keeps therefore still goes where an element or role declares it,
where it lies outside a declared article, or where it is named so outside an article.
Words of a class or id inside an article are a prior only, but for reader comments.
They say nothing about html, body, an article or main part and what holds one, nor
about a branch with half of the text or more, or all named branches where there is no
other text.  An article inside an article (a comment) and what holds it go by their
names.

Never removed by the tree: plain blocks of an article, without class or id (copies of
one page would make them look repeated), and a node with half of its host's different
text whose pages mostly differ.  Equal pages of a host count once.

Null and empty pages give the empty text.  Text outside any block counts as a block of
its parent.  White space is Python's (``str.split``); ``br`` counts as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*>|<![^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PARTS = re.compile(r"[a-z]+|\d+")
# HTML's void, raw-text and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table article main body div section".split())
FURNITURE_TAGS = frozenset("nav footer aside form head select option button dialog svg math object audio video canvas menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond social share sharing related "
    "recommended widget toolbar pagination pager login search skip".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
UNNAMED_TAGS = frozenset("html body article main".split())

COMMENT_NAMES = frozenset("comment comments disqus respond".split())
PLACED = frozenset("div section table ul ol dl center fieldset".split())  # numbered among their parent's, where they have no label

#: What a node must reach of its host's best, pages that the prior counts as, share of presentation in a node's importance.
LOW, PRIOR, PRESENTATION_SHARE = 0.85, 8, 0.1


class Node:
    __slots__ = ("tag", "path", "gone", "named", "inside", "children", "texts", "plain", "links", "placed")

    def __init__(self, tag: str, path: str, gone: bool, named: tuple[int, ...], inside: bool, plain: bool):
        self.tag, self.path, self.gone, self.named, self.inside, self.plain = tag, path, gone, named, inside, plain
        self.children: list[str] = []
        self.texts: list[Block] = []
        self.placed: dict[str, int] = {}


class Block:
    """A block's text and what markup says about it: ``role`` by an element or role, ``named`` by words of a class or id."""

    __slots__ = ("path", "parts", "text", "inside", "role", "branches", "named", "comment", "links", "plain")

    def __init__(self, node: Node, parts: list[tuple[str, tuple[int, ...]]], links: int):
        self.path, self.parts, self.inside, self.role, self.branches, self.plain, self.links = node.path, parts, node.inside, node.gone, node.named, node.plain and node.inside, links
        self.text, self.named, self.comment = "", False, False


class Page:
    """A page's blocks in order, and its block elements for the style tree.

    Branches named like furniture are numbered in order; when all is read, those that
    their names alone don't make furniture are spared.
    """

    def __init__(self, html: str):
        self.insides: list[bool] = []
        self.comments: list[bool] = []
        self.holders: set[int] = set()
        self.content = False
        self.sizes: dict[tuple[bool, tuple[int, ...]], int] = {}
        self.nodes: list[Node] = []
        self.blocks: list[Block] = []
        self.stack = [Node("", "", False, (), False, True)]
        self.open_inline: list[tuple[str, bool, tuple[int, ...]]] = []
        self.pending: list[tuple[str, tuple[int, ...]]] = []
        self.linked = 0
        self.read(html)
        spared = self.misnamed()
        for x in self.blocks:
            left = [k for k in x.branches if k not in spared]
            x.named, x.comment = bool(left), any(self.comments[k] for k in left)
            # Inline elements aren't nodes of the tree: in an article their names count for comments only.
            kept = [t for t, own in x.parts if all(k in spared or (x.inside and not self.comments[k]) for k in own)]
            x.text = " ".join("".join(kept).split())
        self.blocks = [x for x in self.blocks if x.text]
        self.declared = any(x.inside and not x.role and not x.named for x in self.blocks)

    def furniture(self, block: Block) -> bool:
        """Whether markup alone declares a block to be something other than content."""
        return block.role or block.named or (self.declared and not block.inside)

    def certain(self, block: Block) -> bool:
        """The same, but for class and id words inside an article."""
        return block.role or (self.declared and not block.inside) or (block.named and (block.comment or not block.inside))

    def misnamed(self) -> frozenset[int]:
        """Named branches that their names alone don't make furniture."""
        if not self.insides:
            return frozenset()
        # Where a page declares its content, nothing else of it counts.
        sizes = [(named, n) for (inside, named), n in self.sizes.items() if inside or not self.content]
        total = sum(n for _, n in sizes)
        held = dict.fromkeys(range(len(self.insides)), 0)
        for named, n in sizes:
            for k in set(named):
                held[k] += n
        spared = self.holders | {k for k, n in held.items() if n and 2 * n >= total}
        if total and not any(spared.issuperset(named) for named, _ in sizes):
            spared |= {k for k, n in held.items() if n}
        return frozenset(spared)

    def name(self, inside: bool, comment: bool) -> tuple[int, ...]:
        self.insides.append(inside)
        self.comments.append(comment)
        return (len(self.insides) - 1,)

    def text(self, piece: str) -> None:
        top = self.stack[-1]
        if any(gone for _, gone, _ in self.open_inline):
            return
        own = tuple(k for _, _, names in self.open_inline for k in names)
        if not top.gone:
            at = (top.inside, top.named + own)
            self.sizes[at] = self.sizes.get(at, 0) + len(piece.strip())
        self.pending.append((unescape(piece), own))
        if any(tag == "a" for tag, _, _ in self.open_inline):
            self.linked += len(piece.strip())

    def flush(self) -> None:
        if any(t and not t.isspace() for t, _ in self.pending):
            top = self.stack[-1]
            block = Block(top, self.pending, self.linked)
            top.texts.append(block)
            self.blocks.append(block)
        self.pending, self.linked = [], 0

    def close(self, depth: int) -> None:
        self.flush()
        del self.stack[depth:]
        self.open_inline = []

    def start(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            a = attributes(attrs) if attrs.strip() else {}
            words = furniture_names(a, True)
            self.open_inline.append((tag, furniture(tag, a, True), self.name(self.stack[-1].inside, not COMMENT_NAMES.isdisjoint(words)) if words else ()))
            return
        if tag in CLOSES_P:
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].tag == "p":
                    self.close(depth)
                    break
                if self.stack[depth].tag in ("td", "th", "button", "object"):
                    break
        if tag in SIBLINGS:
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].tag in SIBLINGS[tag]:
                    self.close(depth)
                    break
                if self.stack[depth].tag in CONTAINERS:
                    break
        self.flush()
        a = attributes(attrs) if attrs.strip() else {}
        up = self.stack[-1]
        inside = up.inside or tag in CONTENT_TAGS
        label = ".".join(sorted(a.get("class", "").split())) + ("#" + a["id"] if a.get("id") else "")
        gone, named = up.gone or furniture(tag, a, up.inside), up.named
        first = tag in UNNAMED_TAGS and not (up.inside and any(x.tag == "article" for x in self.stack))
        if first and tag in CONTENT_TAGS and not gone:
            self.content = True
            self.holders.update(named, *(own for _, _, own in self.open_inline))
        words = () if first else furniture_names(a, up.inside)
        if words:
            named += self.name(up.inside, not COMMENT_NAMES.isdisjoint(words))
        if label:
            label = f"[{label}]"
        elif tag in PLACED and not inside:
            up.placed[tag] = up.placed.get(tag, 0) + 1
            label = f":{up.placed[tag]}"
        node = Node(tag, f"{up.path}/{tag}{label}", gone, named, inside, up.plain and (label[:1] != "[" or not up.inside))
        self.nodes.append(node)
        up.children.append(tag)
        if tag not in VOID:
            self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag in INLINE:
            for i in range(len(self.open_inline) - 1, -1, -1):
                if self.open_inline[i][0] == tag:
                    del self.open_inline[i]
                    break
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                self.close(depth)
                return

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            piece = html[at : m.start() if m else n]
            if piece:
                self.text(piece)
            if not m:
                break
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
            if m["end"] or m["end2"]:
                self.end(tag)
            elif tag == "br" or tag == "wbr":
                self.pending.append((" " if tag == "br" else "", ()))
            elif tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else n
            else:
                self.start(tag, attrs)
        self.flush()


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTR.findall(text):
        out.setdefault(name.lower(), unescape(value.strip("\"'")))
    return out


def furniture(tag: str, a: dict[str, str], inside: bool) -> bool:
    """Whether an element's tag, role or style declares it to be something other than content."""
    if tag in FURNITURE_TAGS or (tag == "header" and not inside):
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    return a.get("role", "").lower() in FURNITURE_ROLES


def furniture_names(a: dict[str, str], inside: bool) -> set[str]:
    """The words of an element's class or id that furniture has."""
    if not ("class" in a or "id" in a):
        return set()
    names = set(NAME_PARTS.findall((a.get("class", "") + " " + a.get("id", "")).lower()))
    return (names & FURNITURE_NAMES) | (set() if inside else names & {"header"})


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def observations(page: Page) -> list[tuple]:
    """``(path, presentation, content or None, size, links, prior, plain)`` for each path of a page; the last four of its texts."""
    by: dict[str, list] = {}
    for node in page.nodes:
        own = by.setdefault(node.path, [[], []])
        own[0].append(" ".join(node.children))
        own[1] += [x for x in node.texts if x.text]
    out = []
    for path, (shape, blocks) in by.items():
        size = sum(len(x.text) for x in blocks)
        free = sum(len(x.text) for x in blocks if not page.furniture(x))
        links = 0 if all(x.inside for x in blocks) else sum(x.links for x in blocks)
        out.append((path, digest("|".join(shape)), digest("\n".join(x.text for x in blocks)) if blocks else None, size, links, free / size if size else 1.0, bool(blocks) and all(x.plain for x in blocks)))
    return out


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_rows(pages: DataFrame) -> DataFrame:
    """:func:`observations` of ``(host, html)``; ``page`` is a hash of the blocks that markup doesn't declare to be furniture."""
    names = ["host", "path", "presentation", "content", "size", "links", "prior", "plain", "page"]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                page = Page(html.as_py() or "")
                whole = digest("\n".join(x.text for x in page.blocks if not page.furniture(x)))
                out += [(host, *row, whole) for row in observations(page)]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return pages.select("host", "html").mapInArrow(run, "host string, path string, presentation long, content long, size long, links long, prior double, plain boolean, page long")


def entropy(rows: DataFrame, what: str) -> DataFrame:
    """``(host, path, what)`` with an entropy of 0 to 1: that of ``what`` over the pages that have a node, to the base of their number."""
    counts = rows.groupBy("host", "path", what).agg(F.count("*").alias("n"))
    x = counts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    bits = (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")
    return x.select("host", "path", F.when(F.col("pages") > 1, bits).otherwise(1.0).alias(what))


def importances(rows: DataFrame) -> DataFrame:
    """``(host, path, pages, plain, different, seen, importance)`` of every node with text.

    ``seen`` is what its pages say, ``importance`` joins the prior to it; ``different``
    counts the characters of its different texts.
    """
    # Of equal pages one counts; their furniture may differ.
    texts = rows.where("content is not null").groupBy("host", "path", "page").agg(*(F.min(c).alias(c) for c in ("presentation", "content", "size", "links", "prior", "plain")))
    total = texts.groupBy("host", "path").agg(F.count("*").alias("pages"), F.min("plain").alias("plain"), F.avg("prior").alias("prior"), (F.sum("links") / F.sum("size")).alias("links"))
    different = texts.groupBy("host", "path", "content").agg(F.max("size").alias("size")).groupBy("host", "path").agg(F.sum("size").alias("different"))
    joined = total.join(different, ["host", "path"])
    for what in ("presentation", "content"):
        joined = joined.join(entropy(texts, what), ["host", "path"])
    seen = PRESENTATION_SHARE * F.col("presentation") * (1 - F.col("links")) + (1 - PRESENTATION_SHARE) * F.col("content")
    joined = joined.withColumn("seen", seen)
    mixed = ((F.col("pages") - 1) * F.col("seen") + PRIOR * F.col("prior")) / (F.col("pages") - 1 + PRIOR)
    return joined.select("host", "path", "pages", "plain", "different", "content", "seen", mixed.alias("importance"))


def weak_branches(nodes: DataFrame, low: float = LOW) -> DataFrame:
    """``(host, path)`` of the nodes that lie under ``low`` times the importance of their host's best among those that half of its pages have."""
    host = nodes.groupBy("host").agg(F.max("pages").alias("most"), F.sum("different").alias("all"))
    best = nodes.join(host, "host").where(2 * F.col("pages") >= F.col("most")).groupBy("host", "all").agg(F.max("importance").alias("best"))
    bulk = (2 * F.col("different") >= F.col("all")) & (F.col("content") >= 0.5)
    return nodes.join(best, "host").where((F.col("importance") < low * F.col("best")) & ~F.col("plain") & ~bulk).select("host", "path")


def main_text(html: str, dropped: frozenset[str] | set[str]) -> str:
    page = Page(html)
    return "\n".join(x.text for x in page.blocks if x.path not in dropped and not page.certain(x))


def extract(pages: DataFrame, scratch: Scratch, url: str = "url", html: str = "html", low: float = LOW) -> DataFrame:
    """Adds ``text`` and ``n_chars``; input columns of these names are replaced."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars", "_host", "_drop")]
    rows = scratch.save(style_rows(pages.select(host_of(url).alias("host"), F.col(html).alias("html"))), "styles")
    weak = weak_branches(importances(rows), low)
    by_host = scratch.save(weak.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_set("path")).alias("_drop")), "weak")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = [main_text(h.as_py() or "", frozenset(d or ())) for h, d in zip(batch.column(html), batch.column("_drop").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, type=pa.string()), pa.array(map(len, out), type=pa.int64())], names=[*keep, "text", "n_chars"])

    marked = pages.select(*dict.fromkeys([*keep, html, url])).withColumn("_host", host_of(url)).join(by_host, "_host", "left")
    return marked.select(*dict.fromkeys([*keep, html]), "_drop").mapInArrow(run, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))
