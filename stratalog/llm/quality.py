"""Quality classifier by compression.

Two zstandard dictionaries, one from good and one from bad labelled text, compress
every text in fixed blocks; the difference of the two compressed sizes over their sum
is the evidence, and a logistic curve fitted on labelled rows that no dictionary has
seen turns it into a probability.  The curve is fitted with each class weighing as much
as it has among all labelled rows that may be learned from, so a score is the share of
good ones among texts of that score.

Empty and null texts give no evidence and score 0.0.  Repeated rows and equal texts
get equal scores.  Tables without labels of both kinds give a neutral model (every
non-empty text scores the share of good labels, 0.5 without labels).  Only the named
columns are read; others pass through unless they clash with the columns made here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table

BLOCK = 1536
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    prior: float


def learnable(doc_id: str | Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 5, isn't 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % 5 != 0


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[dict[int, list[str]], dict[int, int]]:
    """At most about ``per_class`` labelled texts of each class, by a hash of the id (a documented bound of the fit), and how many there are in all.

    An id with several texts gives the least, so that the bound holds for texts too.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(learnable("doc_id"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for kind in (0, 1):
        share = F.when(F.col("quality") == kind, F.lit(min(1.0, 1.1 * per_class / max(counts.get(kind, 0), 1)))).otherwise(share)
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_003)) < share * 1_000_003)
    # The sample's bound makes it fit for a broadcast; a sort-merge join would shuffle every text.
    few = F.broadcast(chosen.select("doc_id", "quality").limit(4 * per_class))
    rows = docs.select("doc_id", "text").where("text is not null and text <> ''").join(few, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    out: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        out[r["quality"]].append(r["text"])
    return out, counts


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def build_dictionary(texts: list[str], size: int) -> bytes:
    """The strings that recur in many samples, by zstandard's cover algorithm; the samples themselves when they are too few to train on."""
    samples = [b for t in texts for b in blocks(t.encode("utf-8", "surrogatepass"))]
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Scorer:
    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for data in (good, bad):
            kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            book = zstandard.ZstdCompressionDict(data or b" ", dict_type=kind)
            book.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False))

    def evidence(self, text: bytes) -> float:
        """(size under the bad dictionary - size under the good one) / their sum, over all blocks of the whole text."""
        good, bad = (sum(len(c.compress(b)) for b in blocks(text)) for c in self.by)
        return (bad - good) / (bad + good) if good + bad else 0.0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, dictionary_bytes: int = 65536) -> QualityModel:
    """Fits on at most about ``per_class`` labelled texts of each class; half build the dictionaries, half calibrate."""
    by, counts = sample_labelled(docs, labels, per_class)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    half = {k: (v[::2], v[1::2]) for k, v in by.items()}
    if not all(half[k][1] for k in (0, 1)):
        return QualityModel(b"", b"", 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    model = QualityModel(build_dictionary(half[1][0], dictionary_bytes), build_dictionary(half[0][0], dictionary_bytes), 0.0, 0.0, prior)
    scorer = Scorer(model.good, model.bad)
    x = np.array([scorer.evidence(t.encode("utf-8", "surrogatepass")) for k in (0, 1) for t in half[k][1]])
    y = np.array([float(k) for k in (0, 1) for _ in half[k][1]])
    slope, bias = logistic(x, y, prior)
    return QualityModel(model.good, model.bad, slope, bias, prior)


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-5) -> tuple[float, float]:
    """Two-parameter Newton iterations; class 1 has ``share`` of the weight."""
    scale = x.std() or 1.0
    w = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    a, theta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -40, 40)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (w * (y - p)) - ridge * theta)
        theta += step
        if abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def score(df: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Adds ``score`` and ``predicted``; input columns of these names are replaced."""
    keep = [c for c in df.columns if c not in ("score", "predicted")]
    sent = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m.good, m.bad)
        for batch in batches:
            out = []
            for x in batch.column(text).cast(pa.binary() if pa.types.is_string(batch.column(text).type) else pa.large_binary()):
                data = x.as_py() or b""
                z = np.clip(m.slope * (scorer.evidence(data) if m.slope else 0.0) + m.bias, -40, 40)
                out.append(float(1 / (1 + np.exp(-z))) if data else 0.0)
            made = as_table({"score": out, "predicted": [int(s >= threshold) for s in out]}, pa.schema([("score", pa.float64()), ("predicted", pa.int32())]))
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *made.columns], names=[*keep, "score", "predicted"])

    schema = df.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
