"""The production queries of the operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixture, ogg, pieces, quality, rules, set_join, style_tree, suffix_dedup, token_shards
from .common import Scratch

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Whether the remainder is 0; an id that is null has none, so it isn't."""
    return F.coalesce(~quality.learnable(doc_id), F.lit(False)).alias("held_out")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(), "score", "predicted")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(table(spark, sf_dir, "documents"), Scratch(spark, "set-join"), size=4, percent=85)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs, Scratch(spark, "suffixes")).drop("text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, a digest of them, whether decoding gives the text back, and parity with the library, of every text."""
    model = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, check_round_trip=True, parity_share=1)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip", "parity")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as the written shards hold them: slot, shard, document, place in it, ids used, and the ids' CRC-32."""
    pack = token_shards.rank_ids(pieces.read_model(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))
    layout = token_shards.write(table(spark, sf_dir, "documents"), Scratch(spark, "token-shards").root, pack, width=2, length=256, per_shard=16384)
    return token_shards.read(spark, layout).select("slot", "shard", "doc_id", "seq_no", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"), Scratch(spark, "style-tree")).select("page_id", "url", "text", "n_chars")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixture"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"), Scratch(spark, "rules"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), with_media=False).drop("text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.sample_texts(docs)
    net = langid.train(samples) if samples else None
    return langid.predict(docs.select("doc_id", "text"), net).select("doc_id", held_out(), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality_classifier, op2_ngram_jaccard, op3_suffix_dedup, op4_sentencepiece, op5_token_shards, op6_html_extraction, op7_mixture, op8_quality_rules, op9_ogg_media, op10_language_id]
    return {f.__name__: f for f in own}


#: Base statistics by counting every 3-word window, and boilerplate lines by counting documents per host.
RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2) t),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) t WHERE c > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, i AS j FROM rep UNION ALL SELECT r, i + 1 FROM rep UNION ALL SELECT r, i + 2 FROM rep) t GROUP BY r),
raw AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw),
ok AS (SELECT * FROM ln WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ok GROUP BY r),
hosts AS (SELECT source, count(DISTINCT r) AS docs FROM ok GROUP BY source),
common AS (SELECT f.source, norm FROM (SELECT source, norm, count(DISTINCT r) AS n FROM ok GROUP BY source, norm) f JOIN hosts h ON h.source IS NOT DISTINCT FROM f.source WHERE n > 3 AND n > 0.005 * docs),
lost AS (SELECT ok.r, sum(CASE WHEN c.norm IS NULL THEN 0 ELSE ok.n END) AS gone, sum(ok.n) AS total FROM ok LEFT JOIN common c ON c.source IS NOT DISTINCT FROM ok.source AND c.norm = ok.norm GROUP BY ok.r),
base AS (SELECT d.r, d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lost.total - lost.gone < 0.5 * lost.total, FALSE) AS depleted
    FROM d JOIN w ON w.r = d.r LEFT JOIN dup ON dup.r = d.r LEFT JOIN cov ON cov.r = d.r LEFT JOIN lost ON lost.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept FROM base
"""


#: Shared shingles counted pair by pair, and what links reach. The words of a shingle hold no space, so a space parts them.
JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS sh FROM d),
n AS (SELECT r, len(sh) AS n FROM s),
g AS (SELECT r, unnest(sh) AS g FROM s),
hit AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT a, b FROM hit JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b)
SELECT d.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id FROM d JOIN n ON n.r = d.r JOIN (SELECT reach.a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a) c ON c.a = d.r
"""

#: Every 200-byte window by its digest; runs of windows that occur twice, and what they leave. Texts are cut in pieces that overlap only to keep substr cheap.
CUT_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT r, spot, substr(h, 2 * spot + 1, 1398) AS p FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199, 500)) AS spot FROM d WHERE length(h) >= 400)),
win AS (SELECT r, spot + j AS i, md5_number(substr(p, 2 * j + 1, 400)) AS m FROM (SELECT r, spot, p, unnest(range(least(500, length(p) // 2 - 199))) AS j FROM part)),
twice AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM win WHERE m IN (SELECT m FROM twice)),
run AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
keep AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM run UNION ALL SELECT r, max(b), NULL FROM run GROUP BY r),
left_ AS (SELECT k.r, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY x) AS h FROM keep k JOIN d ON d.r = k.r GROUP BY k.r),
tot AS (SELECT r, sum(b - a) AS gone, count(*) AS n FROM run GROUP BY r)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(l.h, d.h))) AS kept_sha256
FROM d LEFT JOIN tot t ON t.r = d.r LEFT JOIN left_ l ON l.r = d.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": JOIN_SQL, "op3_suffix_dedup": CUT_SQL, "op8_quality_rules": RULES_SQL}
