"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of a fixed number of bytes (the last one padded with
zeros), all of them.  Byte embeddings are convolved with filters of several widths,
rectified and max-pooled over the window; a softmax layer turns the pooled features
into log-probabilities, and the mean over a text's windows decides.

In use, embedding and filters are folded: a filter of width two is one row of a
65,536-row table, wider ones are sums of such rows.

Null texts and texts without a letter get ``und`` and score 0.0.  Without training
rows every text gets ``und``.  Equal texts get equal results; ties go to the first
language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, pieces, utf8
from .quality import learnable

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: dict[int, np.ndarray]  # width -> (width * EMBED) x FILTERS
    bias: np.ndarray  # features
    dense: np.ndarray  # features x languages
    offset: np.ndarray  # languages

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Training's forward pass on windows x (n x WINDOW of bytes); also what the backward pass needs."""
        e = self.embed[x]
        out, saved = [], []
        for k, w in enumerate(WIDTHS):
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WINDOW - w + 1, w * EMBED)
            z = cols @ self.filters[w] + self.bias[k * FILTERS : (k + 1) * FILTERS]
            best = z.argmax(1)
            top = np.take_along_axis(z, best[:, None, :], 1)[:, 0]
            out.append(np.maximum(top, 0))
            saved.append((cols, best, top > 0))
        return np.concatenate(out, 1), saved

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width, (offset, table by byte pair or byte) whose rows add up to the convolution."""
        out = {}
        for w in WIDTHS:
            by = [self.embed @ self.filters[w][j * EMBED : (j + 1) * EMBED] for j in range(w)]
            own = [(j, (by[j][:, None, :] + by[j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32)) for j in range(0, w - 1, 2)]
            out[w] = own + ([(w - 1, by[w - 1].astype(np.float32))] if w % 2 else [])
        return out

    def log_probabilities(self, x: np.ndarray, tables: dict) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for k, w in enumerate(WIDTHS):
            n, z = WINDOW - w + 1, None
            for at, table in tables[w]:
                index = pairs if len(table) == 65536 else x
                part = table.take(index[:, at : at + n], axis=0)
                z = part if z is None else np.add(z, part, out=z)
            pooled.append(np.maximum(z.max(1) + self.bias[k * FILTERS : (k + 1) * FILTERS].astype(np.float32), 0))
        z = np.concatenate(pooled, 1).astype(np.float64) @ self.dense + self.offset
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(data: np.ndarray) -> np.ndarray:
    """All windows of one text's bytes; at least one."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def train(samples: dict[str, list[bytes]], epochs: int = 6, per_language: int = 3000, seed: int = 11) -> ByteNet:
    """Adam on windows drawn evenly from each language's sample texts."""
    rng = np.random.default_rng(seed)
    languages = sorted(samples)
    xs, ys = [], []
    for k, name in enumerate(languages):
        own = np.concatenate([windows(np.frombuffer(t, dtype=np.uint8)) for t in samples[name]])
        own = own[rng.permutation(len(own))[:per_language]]
        cut = own.copy()  # short texts: the same windows with a blank tail
        keep = rng.integers(12, WINDOW, len(own))
        cut[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
        xs += [own, cut]
        ys += [np.full(2 * len(own), k)]
    x, y = np.concatenate(xs), np.concatenate(ys)
    features = FILTERS * len(WIDTHS)
    net = ByteNet(languages, rng.normal(0, 0.5, (256, EMBED)), {w: rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)) for w in WIDTHS}, np.zeros(features), rng.normal(0, 0.3, (features, len(languages))), np.zeros(len(languages)))
    params = [net.embed, *net.filters.values(), net.bias, net.dense, net.offset]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 128):
            t += 1
            grads = gradients(net, x[order[low : low + 128]], y[order[low : low + 128]])
            rate = 0.01 * (1 - epoch / epochs)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def gradients(net: ByteNet, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    f, saved = net.features(x)
    z = f @ net.dense + net.offset
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = p @ net.dense.T
    embed, filters, bias = np.zeros_like(net.embed), [], np.zeros_like(net.bias)
    rows = np.arange(len(x))[:, None]
    for k, w in enumerate(WIDTHS):
        cols, best, on = saved[k]
        g = back[:, k * FILTERS : (k + 1) * FILTERS] * on  # n x FILTERS: only the winning place learns
        bias[k * FILTERS : (k + 1) * FILTERS] = g.sum(0)
        filters.append(np.einsum("nfc,nf->cf", cols[rows, best], g, optimize=True))
        to = g[:, :, None] * net.filters[w].T[None]  # n x FILTERS x (w * EMBED)
        for j in range(w):
            np.add.at(embed, x[rows, best + j], to[:, :, j * EMBED : (j + 1) * EMBED])
    return [embed, *filters, bias, f.T @ p, p.sum(0)]


def sample_texts(df: DataFrame, per_language: int = 400, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, list[bytes]]:
    """About ``per_language`` texts of each language (a documented bound of the fit), chosen by a hash of the id among learnable rows."""
    rows = df.where(learnable(key) & F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in df.where(learnable(key) & F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))])
    chosen = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("lang")), F.lit(1_000_003)) < share[F.col(lang)] * 1_000_003)
    out: dict[str, list[bytes]] = {}
    for r in sorted(chosen.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.encode(F.col(text), "UTF-8").alias("t")).collect(), key=lambda r: (r["k"], r["t"])):
        out.setdefault(r["l"], []).append(bytes(r["t"]))
    return out


def predict(df: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (its probability); input columns of these names are replaced."""
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    sent = df.sparkSession.sparkContext.broadcast(net)  # a network of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.tables() if net else {}
        for batch in batches:
            column = batch.column(text)
            data, offsets = utf8(column)
            found = [x.as_py() is not None and LETTER.search(x.as_py()) is not None for x in column]
            names, scores = [], []
            for low, high in pieces(offsets, 1 << 17):
                counts = np.maximum(1, -(-np.diff(offsets[low : high + 1]) // WINDOW))
                total = np.zeros((high - low, len(net.languages) if net else 1))
                if net:
                    x = np.concatenate([windows(data[offsets[i] : offsets[i + 1]]) for i in range(low, high)])
                    logs = np.concatenate([net.log_probabilities(x[i : i + 512], tables) for i in range(0, len(x), 512)])
                    total = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) / counts[:, None]
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, row in zip(range(low, high), p):
                    known = bool(net) and found[i]
                    names.append(net.languages[int(row.argmax())] if known else UNDETERMINED)
                    scores.append(float(row.max()) if known else 0.0)
            made = as_table({"lang_pred": names, "score": scores}, pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made.columns], names=[*keep, "lang_pred", "score"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, df.select(*keep).schema.add("lang_pred", "string").add("score", "double"))
