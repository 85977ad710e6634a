"""Suffix-array dedup: removes every byte that a long string covers which also starts elsewhere.

Texts are UTF-8 bytes; a window is ``length`` of them (200).  A shard's suffix array,
sorted by induction, and its permuted common prefixes tell which windows occur twice.
What makes shards exact is how they are filled:

* Every window's anchor is the place of the smallest hash of its ``gram``-byte
  strings, leftmost if equal.  It depends on the window's bytes alone, so equal
  windows have equal anchor strings at equal places.  Consecutive windows of one
  anchor are a cell; cells part a text's windows.
* Cells are dealt by a hash of the anchor string.  A cell alone with its anchor has no
  repeated window.  Cells equal as a whole repeat all of their windows.  One of each
  different cells with a common anchor goes to the shards as text, and all with one
  anchor go to the same.

* An anchor that many different cells share (a passage that stands in a third of all
  texts, with other words around it) would fill one shard.  Such cells become texts of
  their own and are cut again by anchors of another hash, which lie in the words around
  the passage for what differs and in the passage for what is equal.

Only anchors (about one in sixty bytes) and the texts of cells with a partly different
twin are shuffled.  Equal cells are counted before they are dealt, so a group of copies
meets as a few rows and never as text.  Texts without a repeated window, as far as a map
of marked keys tells, pass without a shuffle.

Nulls are empty texts, which have no window.  Equal rows are separate places, so a
text that occurs in two rows is removed from both.  Removed runs are judged on bytes;
``kept_text`` drops a run's whole characters only.  Hashes of 64 bits each stand for
anchors and whole cells, which are compared only together; a row is known by a 64-bit
hash of id and text, the text's length and its CRC-32.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Powers, Scratch, byte_weights, marked, mix64, mix_int, partitions, utf8
from .suffixes import common_prefixes, suffix_array

LENGTH, GRAM = 200, 64
#: Bytes hashed at once; longer texts are cut where windows part.
STRETCH = 1 << 17
PLACE_BITS = 18
#: Text of a shard; one anchor's cells are never parted.
SHARD = 1 << 20
#: Different cells of one anchor that one shard takes; more are cut again, at most ``DEEPEST`` times.
CROWD, DEEPEST = 256, 3
CELL_SALT = np.uint64(mix_int(41) | 1)


class CellCutter:
    def __init__(self, length: int = LENGTH, gram: int = GRAM, seed: int = 0):
        self.length, self.gram, self.reach = length, gram, length - gram + 1
        self.powers, self.weights = Powers(), byte_weights(23 + 1000 * seed)

    def stretches(self, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges of whole texts up to STRETCH, or of a longer text, overlapping so that each window lies in one."""
        row, rows = 0, len(offsets) - 1
        while row < rows:
            last = int(np.searchsorted(offsets, offsets[row] + STRETCH, side="right")) - 1
            if last > row:
                yield int(offsets[row]), int(offsets[last])
                row = last
                continue
            at, end = int(offsets[row]), int(offsets[row + 1])
            while end - at >= self.length:
                yield at, min(at + STRETCH, end)
                if at + STRETCH >= end:
                    break
                at += STRETCH - self.length + 1
            row += 1

    def sliding_minimum(self, x: np.ndarray) -> np.ndarray:
        """Minima of all runs of ``reach`` values, from minima within blocks forwards and backwards."""
        w = self.reach
        padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(x)] = x
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - w + 1
        return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])

    def cells(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, row, first window, last window, cell hash); windows count from the text's start."""
        out = [tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64, np.uint64))]
        for a, b in self.stretches(offsets):
            if b - a < self.length:
                continue
            up, down = self.powers.get(b - a + 1)
            total = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(self.weights[data[a:b]] * up[: b - a], out=total[1:])
            grams = mix64((total[self.gram :] - total[: -self.gram]) * down[: b - a - self.gram + 1])
            places = np.arange(len(grams), dtype=np.uint64)
            least = self.sliding_minimum(((grams >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)) | places)
            row = np.searchsorted(offsets, np.arange(a, b - self.length + 1), side="right") - 1
            window = np.flatnonzero(np.arange(a, b - self.length + 1) + self.length <= offsets[row + 1])
            anchor = (least[window] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            if not len(window):
                continue
            fresh = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            first, last = window[fresh], window[np.concatenate([fresh[1:] - 1, [len(window) - 1]])]
            text = (total[last + self.length] - total[first]) * down[first]
            cell = mix64(text + (last - first).astype(np.uint64) * CELL_SALT)
            row = row[first]
            base = offsets[row] - a
            out.append((grams[anchor[fresh]], row, first - base, last - base, cell))
        return tuple(np.concatenate(x) for x in zip(*out))


def cell_rows(texts: DataFrame, length: int, gram: int, once: bool, seed: int = 0) -> DataFrame:
    """``(anchor, key, tail, low, high, cell, n)`` of ``(key, tail, text)``: every cell, or ``once`` for all ``n`` equal ones of some hundred texts."""
    names = ["anchor", "key", "tail", "low", "high", "cell", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = CellCutter(length, gram, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                anchor, row, low, high, cell = cutter.cells(*utf8(batch.column("text")))
                key, tail, n = batch.column("key").to_numpy()[row], batch.column("tail").to_numpy()[row], np.ones(len(cell), dtype=np.int64)
                if once:
                    order = np.lexsort((anchor, cell))
                    anchor, key, tail, low, high, cell = (x[order] for x in (anchor, key, tail, low, high, cell))
                    first = np.flatnonzero(np.concatenate([[True] * (len(cell) > 0), (cell[1:] != cell[:-1]) | (anchor[1:] != anchor[:-1])]))
                    n = np.diff(np.concatenate([first, [len(cell)]]))
                    anchor, key, tail, low, high, cell = (x[first] for x in (anchor, key, tail, low, high, cell))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), key, tail, low, high, cell.view(np.int64), n)], names=names)

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def shared_cells(cells: DataFrame) -> DataFrame:
    """One row for each cell that isn't alone with its anchor: ``whole``, if there are equal ones, and ``shown``, if there are different ones."""
    w = Window.partitionBy("anchor").orderBy("cell", "key", "tail", "low")
    group = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = cells.withColumn("before", F.lag("cell").over(w)).withColumn("after", F.lead("cell").over(w))
    rows = rows.withColumn("least", F.first("cell").over(w)).withColumn("most", F.last("cell").over(group))
    rows = rows.where(F.col("before").isNull() | (F.col("before") != F.col("cell")))
    whole = (F.col("n") > 1) | F.coalesce(F.col("after") == F.col("cell"), F.lit(False))
    return rows.select("anchor", "cell", "key", "tail", "low", "high", whole.alias("whole"), (F.col("least") != F.col("most")).alias("shown")).where("whole or shown")


def shown_texts(cells: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``(anchor, key, tail, low, whole, bytes)`` of the cells whose texts the shards need."""
    need = cells.where("shown").groupBy("key", "tail").agg(F.collect_list(F.struct("low", "high", "anchor", "whole")).alias("cells"))
    names = ["anchor", "key", "tail", "low", "whole", "bytes"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                out = []
                for key, tail, text, own in zip(batch.column("key").to_pylist(), batch.column("tail").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("cells").to_pylist()):
                    data = text.as_py()
                    out += [(c["anchor"], key, tail, c["low"], c["whole"], data[c["low"] : c["high"] + length]) for c in own]
                columns = list(zip(*out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(columns, kinds)], names=names)

    some = marked(texts, F.col("key"), need, F.col("key")).where("_maybe").drop("_maybe")
    # Equal rows have one key and equal texts: any of them serves, so one is enough.
    return some.join(need, ["key", "tail"]).mapInArrow(run, "anchor long, key long, tail long, low long, whole boolean, bytes binary").dropDuplicates(["anchor", "key", "tail", "low"])


def repeated_windows(cells: list[bytes], length: int) -> list[np.ndarray]:
    """For each of different cells, its windows that occur in another one, by the shard's suffix array."""
    size = np.array([len(c) + 1 for c in cells])
    data = np.frombuffer(b"\0".join(cells) + b"\0", dtype=np.uint8)
    first = np.cumsum(size) - size
    room = np.repeat(first + size - 1, size) - np.arange(len(data))  # bytes up to the separator; 0 on it
    sa = suffix_array(np.where(room > 0, data.astype(np.int64) + 1, 0), 257)
    prefix = common_prefixes(data, room, sa)
    twice = prefix >= length
    twice[sa[:-1]] |= prefix[sa[1:]] >= length
    return [np.flatnonzero(twice[a : a + n]) for a, n in zip(first, size)]


def runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Inclusive (first, last) of the maximal runs of consecutive numbers."""
    if not len(sorted_):
        return []
    cut = np.flatnonzero(np.diff(sorted_) > 1)
    return list(zip(sorted_[np.concatenate([[0], cut + 1])].tolist(), sorted_[np.concatenate([cut, [len(sorted_) - 1]])].tolist()))


def shard_ranges(texts: DataFrame, n: int, length: int) -> DataFrame:
    """``(key, tail, low, high)``: ranges of repeated windows that the shards' suffix arrays find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            out = []
            for (_, key, tail, low, whole, _), found in zip(held, repeated_windows([c[5] for c in held], length)):
                if not whole:
                    out += [(key, tail, low + a, low + b) for a, b in runs(found)]
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (list(zip(*out)) or [[]] * 4)], names=["key", "tail", "low", "high"])

        for batch in batches:
            for cell in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "tail", "low", "whole", "bytes"))):
                if size >= SHARD and cell[0] != last:
                    yield flush()
                    held, size = [], 0
                held.append(cell)
                size, last = size + len(cell[5]), cell[0]
        if held:
            yield flush()

    return texts.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "key long, tail long, low long, high long")


def repeated_ranges(texts: DataFrame, scratch: Scratch, length: int, gram: int, depth: int = 0) -> DataFrame:
    """``(key, tail, low, high)``: ranges of the windows of ``(key, tail, text)`` that occur twice or more."""
    save = lambda df, name: scratch.save(df, f"{name}-{depth}")
    shared = save(shared_cells(cell_rows(texts, length, gram, True, depth)), "shared")
    # Places of equal cells may be a third of all: they meet the list of such cells in a join, which can split them.
    equal = shared.where("whole").select("anchor", "cell")
    whole = save(cell_rows(texts, length, gram, False, depth).join(equal, ["anchor", "cell"], "left_semi").select("key", "tail", "low", "high"), "whole")
    crowds = shared.where("shown").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("anchor")
    shown = save(shown_texts(shared, texts, length), "shown")
    crowded = shown.join(crowds, "anchor", "left_semi")
    if depth == DEEPEST or crowded.isEmpty():
        return save(shard_ranges(shown, partitions(scratch.spark), length), "ranges").union(whole)
    ranges = save(shard_ranges(shown.join(crowds, "anchor", "left_anti"), partitions(scratch.spark), length), "ranges")
    # A cell alone of its kind has a repeated window only where another cell has it, so cells are texts here.
    name = (F.xxhash64("key", "tail", "low"), F.xxhash64("low", "anchor", "tail", "key"))
    cells = save(crowded.select(name[0].alias("key"), name[1].alias("tail"), F.col("bytes").alias("text"), F.col("key").alias("of"), F.col("tail").alias("of_tail"), F.col("low").alias("start"), "whole"), "cells")
    inner = repeated_ranges(cells.select("key", "tail", "text"), scratch, length, gram, depth + 1)
    places = cells.where("not whole").select("key", "tail", "of", "of_tail", "start")
    back = inner.join(places, ["key", "tail"]).select(F.col("of").alias("key"), F.col("of_tail").alias("tail"), (F.col("low") + F.col("start")).alias("low"), (F.col("high") + F.col("start")).alias("high"))
    return ranges.union(whole).union(back)


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Half-open byte runs that ranges of window starts cover."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + length)
        else:
            out.append([low, high + length])
    return [(a, b) for a, b in out]


def keep_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


MADE = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def dedup(docs: DataFrame, scratch: Scratch, text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Adds ``n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text`` if asked for); input columns of these names are replaced."""
    made = MADE[: 4 + with_text]
    keep = [c for c in docs.columns if c not in (*made, "_key", "_tail", "_ranges", "_maybe", "_spot", "_at", "_bucket", "_bits", "_byte")]
    key = F.xxhash64(*[F.col(c).cast("string") for c in ("doc_id", text) if c in docs.columns])
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    tail = F.octet_length(body).cast("long") * F.lit(1 << 32) + F.crc32(body)
    long_ = docs.where(F.octet_length(text) >= length).select(key.alias("key"), tail.alias("tail"), body.alias("text"))
    every = scratch.save(repeated_ranges(long_, scratch, length, gram), "every")
    scratch.drop(*(f"{name}-{depth}" for name in ("shared", "whole", "shown", "ranges", "cells") for depth in range(DEEPEST + 1)))
    by_key = every.groupBy(F.col("key").alias("_key"), F.col("tail").alias("_tail")).agg(F.collect_list(F.struct("low", "high")).alias("_ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for data, own in zip(batch.column(text).cast(pa.large_binary()), batch.column("_ranges").to_pylist()):
                    data = data.as_py() or b""
                    spans = covered([(r["low"], r["high"]) for r in own or []], length)
                    left = cut(data, spans)
                    row = [len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()]
                    out.append([*row, cut(data, keep_characters(data, spans)).decode() if with_text else None][: len(made)])
                columns = list(zip(*out)) or [[]] * len(made)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, type=k) for x, k in zip(columns, kinds))], names=[*keep, *made])

    schema = docs.select(*keep).schema
    for name in made:
        schema = schema.add(name, "string" if name.startswith("kept") else "long")
    rows = docs.select(*dict.fromkeys([*keep, text])).withColumn("_key", key).withColumn("_tail", tail)
    rows = marked(rows, F.col("_key"), every, F.col("key"))
    cut_ = rows.where("_maybe").join(by_key, ["_key", "_tail"], "left").select(*dict.fromkeys([*keep, text]), "_ranges")
    as_is = rows.where("not _maybe").select(*dict.fromkeys([*keep, text]), F.lit(None).cast(cut_.schema["_ranges"].dataType).alias("_ranges"))
    return cut_.unionByName(as_is).mapInArrow(run, schema)
