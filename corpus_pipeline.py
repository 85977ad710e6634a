"""A corpus pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept
and returns the columns of ``docs``; the last adds token ids.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import mixture, pieces, quality, set_join, suffix_dedup
from stratalog.llm.common import Scratch, marked

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and how to name them back: a stage's own results may have the same names."""
    back = {f"_own_{c}": c for c in names if c in docs.columns}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mine, back = set_aside(docs, ["score", "predicted"])
    return quality.score(mine, model).where("predicted = 1").drop("score", "predicted").withColumnsRenamed(back).select(*docs.columns)


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with one of the rows of equal id and text, nulls included. Only rows that may be repeated are shuffled with their texts."""
    row = F.xxhash64("doc_id", "text")
    again = scratch.save(docs.groupBy(row.alias("_hash")).agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "again")
    rows = marked(docs, row, again, F.col("_hash"))
    one = scratch.save(rows.where("_maybe").dropDuplicates(["doc_id", "text"]).select(*docs.columns), "one")
    return rows.where("not _maybe").select(*docs.columns).unionByName(one)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 similarity of five-word shingles connect, one row stays: that of the smallest id.

    A row is known by its id and a hash of its text: repeated rows are one, an id's
    other texts are judged by themselves, and rows without an id come last.
    """
    scratch = Scratch(spark, "near-duplicates")
    rows = one_of_each(docs, scratch).withColumn("_row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    groups = set_join.join(rows.select(F.col("_row").alias("doc_id"), "text"), scratch, size=5, percent=80)
    extra = scratch.save(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_row")), "extra")
    rows = marked(rows, F.col("_row"), extra, F.col("_row"))
    left = rows.where("_maybe").join(extra, "_row", "left_anti").unionByName(rows.where("not _maybe"))
    return left.select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut out; documents of nothing else go."""
    mine, back = set_aside(docs, suffix_dedup.MADE)
    out = suffix_dedup.dedup(mine, Scratch(spark, "suffixes"), with_text=True)
    out = out.where("not (n_removed > 0 and kept_text = '')").withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(*suffix_dedup.MADE).withColumnsRenamed(back).select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: rows repeat, and documents it doesn't take go."""
    taken = mixture.mix(docs, Scratch(spark, "mixture")).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.expr("least(3, ceil(_sum / _rows))").cast("int").alias("_copies"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (mixture.words("text") == F.col("_size"))
    copies = docs.join(taken, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    out = pieces.encode(docs, pieces.read_model(MODEL))
    return out.select("doc_id", "lang", "source", "text", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("mixture", mixture_stage),
    ("tokens", token_stage),
]

#: The stages fit models, draw at random and sort suffixes: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
