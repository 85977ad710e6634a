"""Quality rules: statistics of a text and cross-document line frequency, in DataFrame functions only.

A line's normal form is lower case with digits as 0 and white space squeezed; lines
without a word don't count.  A line that occurs in more than ``max_share`` of a host's
documents with a line, and in more than ``max_docs`` of them, is boilerplate and is
removed there; a document of which less than ``min_left`` of the words are left is
depleted and rejected.  The share makes the verdict on a document the same however much
of its host is there.  Boilerplate lines meet their documents in a join by host and
line; of a very frequent line's rows, which are one key, an adaptive skew join makes
several tasks.

Null and empty texts have no words, lines or symbols and fail the base rules.  A null
host is a host of its own.  Rows equal in id, host and text are one document for line
counts and get equal results.  Clashing columns of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch

SYMBOL = r"[#*$%&|<>]"
GAP = r"[\x20\x09-\x0D]"


def let(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value, worked out once: a named column would be copied into every use when a filter moves below it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def repeated_words(words: str) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included.

    Sorted longs, one a window, hold what has room of the window's hash above its start,
    which takes as many low bits as the text's length needs.  Windows whose hash bits
    have a twin (all repeated ones, and few others) are sorted by their words; equal
    windows are then neighbours.  The starts that have one are sorted again, and each
    adds the words that the one before doesn't cover.
    """
    window = "xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))"
    keys = f"sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft({window}, bits) | CAST(i AS BIGINT)))"
    spot = "struct(struct(get(w, i) AS a, get(w, i + 1) AS b, get(w, i + 2) AS c) AS words, CAST(i AS BIGINT) AS at)"
    twins = f"""sort_array(transform(filter(keys,
        (x, i) -> shiftright(x, bits) = shiftright(get(keys, i + 1), bits) OR shiftright(x, bits) = shiftright(get(keys, i - 1), bits)),
        x -> {let("i", "CAST(x & (shiftleft(1L, bits) - 1L) AS INT)", spot)}))"""
    total = """aggregate(
        sort_array(transform(filter(twins, (x, i) -> x.words = get(twins, i + 1).words OR x.words = get(twins, i - 1).words), x -> x.at)),
        struct(0L AS total, -3L AS last), (s, x) -> struct(s.total + least(3L, x - s.last) AS total, x AS last), s -> s.total)"""
    many = let("bits", "length(bin(size(w)))", let("keys", keys, let("twins", twins, total)))
    return F.expr(let("w", words, f"CASE WHEN size(w) < 4 THEN 0L ELSE {many} END"))


def statistics(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Rows ``(doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    t = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("text_hash"), body.alias("body"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    t = t.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("words").alias("n_repeat_words"),
    )
    return t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_rows(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Rows ``(doc_id, host, text_hash, line, n)``: a normal form's hash and its words, once for each document that has it."""
    normal = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), "[0-9]", "0"), GAP + "+", " "))
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("text_hash"), F.explode(F.split(F.col(text), "\n")).alias("raw"))
    rows = rows.select("doc_id", "host", "text_hash", F.xxhash64(normal).alias("line"), F.regexp_count("raw", F.lit(WORD)).cast("long").alias("n")).where("n > 0")
    return rows.groupBy("doc_id", "host", "text_hash", "line").agg(F.sum("n").alias("n"))


def boilerplate(lines: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """``(h, l)``: the lines that too many documents of their host have."""
    hosts = lines.select("doc_id", "host", "text_hash").distinct().groupBy(F.col("host").alias("h")).agg(F.count("*").alias("all"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("docs") > max_share * F.col("all")).select("h", F.col("line").alias("l"))


def depleted(lines: DataFrame, max_docs: int, max_share: float, min_left: float) -> DataFrame:
    """Documents of which too little is left without their hosts' boilerplate lines, with the words removed and in all.

    Both counts are sums over equal rows, so their ratio is that of one row.
    """
    common = boilerplate(lines, max_docs, max_share)
    marked = lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left")
    sums = marked.groupBy("doc_id", "host", "text_hash").agg(F.sum(F.when(F.col("l").isNotNull(), F.col("n")).otherwise(0)).alias("removed"), F.sum("n").alias("all"))
    return sums.where(F.col("all") - F.col("removed") < min_left * F.col("all"))


def judge(docs: DataFrame, scratch: Scratch, host: str = "source", text: str = "text", max_docs: int = 3, max_share: float = 0.005, min_left: float = 0.5) -> DataFrame:
    """:func:`statistics` with ``kept``: neither the base rules nor line frequency reject the document."""
    lines = scratch.save(line_rows(docs, host, text), "lines")
    bad = depleted(lines, max_docs, max_share, min_left).select(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("text_hash").alias("t"))
    base = statistics(docs, host, text)
    on = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h")) & (F.col("text_hash") == F.col("t"))
    return base.join(bad, on, "left").withColumn("kept", ~F.col("base_failed") & F.col("t").isNull()).drop("d", "h", "t")


def strip_lines(docs: DataFrame, scratch: Scratch, host: str = "source", text: str = "text", max_docs: int = 3, max_share: float = 0.005) -> DataFrame:
    """``docs`` with each host's boilerplate lines removed from ``text``; other lines stay as they are, in order."""
    cols = docs.columns
    lines = scratch.save(line_rows(docs, host, text), "strip-lines")
    common = boilerplate(lines, max_docs, max_share)
    hits = lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).groupBy("doc_id", "host", "text_hash").agg(F.collect_set("line").alias("_drop"))
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("host").alias("_h"), F.col("text_hash").alias("_t"), "_drop")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col(host).cast("string").eqNullSafe(F.col("_h")) & (F.xxhash64(text) == F.col("_t"))
    normal = lambda x: F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), GAP + "+", " ")))
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), normal(x)), F.lit(False))), "\n")
    return docs.join(hits, on, "left").withColumn(text, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(left)).select(*cols)
