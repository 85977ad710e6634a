"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

Sets of word shingles are sorted into size bands so that two sets within the threshold
lie in one band or in neighbours.  A band bounds the symmetric difference of its pairs
by H; its token universe is hashed into segments.

* Exact segments: of H + 1 + g segments at least g + 1 are equal in a pair.  A set
  with at most g empty segments needs to index only the others; one with more indexes
  all, so two such sets still meet.
* One-deletion neighbourhoods: of ceil((H + 1) / 2) segments at least one differs by
  one token or none, so a segment's sum and its sums without one token meet.

A cost model (signatures, and those too small to select) allocates one of the two to
each band, the same for all tables.  Sets that share a signature are candidates;
parity sketches reject pairs whose symmetric difference must be too large, never one
within the threshold; what is left is verified on the words of the texts.

Groups of copies never expand into pairs.  Equal sets are one class.  Pairs of a bucket of
at most ``LISTED`` classes, and those of any bucket's classes with its smallest, are listed
once each, however many buckets they share, and what the sketches leave is kept.  Classes
are first linked to the nearest of these.  Then larger buckets are dealt, once: every pair
of different components that the sketch can't reject is kept as well.  A pair inside a
component can't change the result, so the components are those of all links.  A bucket is
dealt in blocks of some hundred classes, each pair of blocks to a task of its own, so that
no task holds a bucket; the work still grows with the square of a bucket whose classes
aren't linked.

Pairs do far less: a class with more than ``CROWD`` pairs in a bucket that the sketch can't
reject is crowded there, and pairs of two such classes aren't kept.  Each crowded class
attends at most ``ATTENDED`` of these buckets with its whole set.  A cell decides its pairs
by these, and only links that join what the cell hasn't joined yet leave it, fewer than it
has classes.  In the last turn the crowded classes are dealt again, and a pair that attended
one bucket isn't made.  Links of whole sets are verified on words too; should one fail, two
shingles have one hash, and a turn without what whole sets decided follows.

Texts that are not in question pass a map of marked ids and are never shuffled, at any
size of the input.

Null and empty texts and texts without a word have an empty set and are linked with
nothing.  Rows without an id get a set size and no component.  Rows with equal id and
text are one document.  In the search 64-bit hashes stand for shingles and sets.  Sets of
one hash are one class; a second hash must agree, or the run fails and asks for another
``salt``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, marked, mix64, mix_int, partitions, pieces, utf8
from .shingles import WordHasher, exact_overlap, shingle_sets

BYTES = 1 << 20  # text bytes worked on at once
BLOCK = 512  # classes of a bucket that a task compares with as many others
LISTED = 8  # classes of a bucket up to which its pairs are listed one by one
CROWD = 8  # pairs of a class in a bucket, left by the sketch, from which on sets are compared whole
ATTENDED = 2  # such buckets to which a class takes its whole set
ROOM = 1 << 21  # tokens of a block of whole sets
SEGMENT_SALT, SUM_SALT, CLASS_SALT, SKETCH_SALT, SIGN_SALT, CHECK_SALT = (np.uint64(mix_int(300 + i) | 1) for i in range(6))


def most_errors(total, percent: int):
    """The largest symmetric difference of two sets of ``total`` tokens together whose Jaccard similarity is ``percent`` or more."""
    return total - 2 * -(-percent * total // (100 + percent))


@dataclass(frozen=True)
class Band:
    low: int
    errors: int
    segments: int
    spare: int
    deletions: bool


def poisson_tail(mean: float, k: int) -> float:
    return max(0.0, 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k + 1)))


def allocate(low: int, errors: int, weak_cost: float = 6.0, sparse_cost: float = 500.0) -> Band:
    """The cheapest of exact segments, with more or fewer to spare, and one-deletion neighbourhoods for a band's smallest sets.

    A signature costs 1, one of a segment with a token or none (two with deletions)
    ``weak_cost`` more; ``sparse_cost`` is that of a set with more empty segments than
    there are to spare, whose signatures of empty segments many share.
    """
    found = []
    for spare in range(25):
        m = errors + 1 + spare
        k = low / m
        cost = m * (1 + weak_cost * math.exp(-k) * (1 + k)) + sparse_cost * poisson_tail(m * math.exp(-k), spare)
        found.append((cost, Band(low, errors, m, spare, False)))
    m = -(-(errors + 1) // 2)
    k = low / m
    found.append((low + m + weak_cost * m * math.exp(-k) * (1 + k + k * k / 2), Band(low, errors, m, 0, True)))
    return min(found, key=lambda x: x[0])[1]


class Bands:
    """Bands up to the largest set seen, made on demand; the same everywhere."""

    def __init__(self, percent: int):
        self.percent, self.all, self.next = percent, [], 1

    def upto(self, n: int) -> list[Band]:
        while self.next <= n:
            low = self.next
            self.next = 100 * low // self.percent + 1
            high = self.next - 1
            most = high + 100 * high // self.percent
            errors = max(most_errors(s, self.percent) for s in range(max(2 * low, most - 64), most + 1))
            self.all.append(allocate(low, errors))
        return self.all


class SetBuilder:
    """Sets, classes, sketches and signatures of a batch of texts."""

    def __init__(self, size: int, percent: int, salt: int = 0):
        self.size, self.percent, self.salt = size, percent, np.uint64(mix_int(salt)) if salt else np.uint64(0)
        self.hasher, self.bands = WordHasher(), Bands(percent)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, token) sorted, and set sizes."""
        rows = len(offsets) - 1
        row, token = shingle_sets(*self.hasher(data, offsets), rows, self.size)
        return row, token, np.bincount(row, minlength=rows)

    def classes(self, row: np.ndarray, token: np.ndarray, n: np.ndarray, key: np.uint64 = CLASS_SALT) -> np.ndarray:
        """A hash of each set as a whole; 0 for an empty one."""
        total = np.zeros(len(n), dtype=np.uint64)
        full = np.flatnonzero(n > 0)
        if len(full):  # tokens are sorted by row
            total[full] = np.add.reduceat(mix64(token ^ key ^ self.salt), (np.cumsum(n) - n)[full])
        return np.where(n > 0, mix64(total + n.astype(np.uint64) * key) | np.uint64(1), np.uint64(0))

    def sketches(self, row: np.ndarray, token: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Parities of hashed tokens, eight times as many bits as the errors allowed."""
        bits = np.array([sketch_bits(int(x), self.percent) for x in n], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(bits // 64)])
        place = (mix64(token ^ SKETCH_SALT) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
        out = np.zeros(base[-1], dtype=np.uint64)
        np.bitwise_xor.at(out, base[row] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        return [out[a:b].tobytes() for a, b in zip(base[:-1], base[1:])]

    def signatures(self, row: np.ndarray, token: np.ndarray, n: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, row) of the chosen rows, in their own band and in the one below."""
        bands = self.bands.upto(int(n.max(initial=1)))
        own = np.searchsorted(np.array([b.low for b in bands]), n, side="right") - 1
        segments, spare, deletions = (np.array([getattr(b, f) for b in bands]) for f in ("segments", "spare", "deletions"))
        keep = chosen[row]
        row, token = row[keep], token[keep]
        where, value = mix64(token ^ SEGMENT_SALT), mix64(token ^ SUM_SALT)
        signs, owners = [], []
        for step in (0, 1):
            band = own - step
            use = chosen & (n > 0) & (band >= 0)
            m = np.where(use, segments[np.maximum(band, 0)], 0)
            base = np.concatenate([[0], np.cumsum(m)])
            on = use[row]
            r, v = row[on], value[on]
            if not len(r):
                continue
            at = base[r] + (where[on] % m[r].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(base[-1], dtype=np.uint64)
            np.add.at(sums, at, v)
            full = np.bincount(at, minlength=base[-1]) > 0
            owner = np.repeat(np.arange(len(m)), m)
            number = np.arange(base[-1]) - base[owner]
            name = mix64((band[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + SIGN_SALT)
            empty = m - np.bincount(owner[full], minlength=len(m))
            by_deletion = deletions[np.maximum(band, 0)]
            emit = full | by_deletion[owner] | (empty > spare[np.maximum(band, 0)])[owner]
            signs.append(mix64(sums[emit] ^ name[emit]))
            owners.append(owner[emit])
            less = by_deletion[r]
            signs.append(mix64((sums[at[less]] - v[less]) ^ name[at[less]]))
            owners.append(r[less])
        if not signs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(signs), np.concatenate(owners)


def sketch_bits(n: int, percent: int) -> int:
    errors = most_errors(n + 100 * n // percent, percent)
    return max(64, 1 << (8 * errors).bit_length())


def class_rows(docs: DataFrame, size: int, percent: int, salt: int = 0) -> DataFrame:
    """``(doc_id, n_shingles, cls, other, sketch)`` per row of ``docs``; ``other`` is a second hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = SetBuilder(size, percent, salt)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in pieces(offsets, BYTES):
                at = offsets[low : high + 1]
                row, token, n = b.sets(data[at[0] : at[-1]], at - at[0])
                cls = b.classes(row, token, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(n.astype(np.int64)), pa.array(cls.view(np.int64)), pa.array(b.classes(row, token, n, CHECK_SALT).view(np.int64)), pa.array(b.sketches(row, token, n), type=pa.binary())],
                    names=["doc_id", "n_shingles", "cls", "other", "sketch"],
                )

    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("cls", "long").add("other", "long").add("sketch", "binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def signature_rows(docs: DataFrame, size: int, percent: int, salt: int = 0) -> DataFrame:
    """``(sig, cls)``, once for each class of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = SetBuilder(size, percent, salt)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            seen: set[int] = set()
            for low, high in pieces(offsets, BYTES):
                at = offsets[low : high + 1]
                row, token, n = b.sets(data[at[0] : at[-1]], at - at[0])
                cls = b.classes(row, token, n)
                chosen = np.zeros(len(n), dtype=bool)
                _, first = np.unique(cls, return_index=True)
                chosen[[i for i in first if int(cls[i]) not in seen]] = True
                seen.update(cls[chosen].tolist())
                sig, owner = b.signatures(row, token, n, chosen & (n > 0))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls[owner].view(np.int64))], names=["sig", "cls"])

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "sig long, cls long")


def class_sets(texts: DataFrame, size: int, percent: int, salt: int = 0) -> DataFrame:
    """``(cls, tokens)``: the sorted hashes of a class's set, from ``(cls, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = SetBuilder(size, percent, salt)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in pieces(offsets, BYTES):
                at = offsets[low : high + 1]
                row, token, n = b.sets(data[at[0] : at[-1]], at - at[0])
                end = np.cumsum(n)
                out = pa.RecordBatch.from_arrays([batch.column("cls").slice(low, high - low), pa.array([token[x:y].tobytes() for x, y in zip(end - n, end)], type=pa.binary())], names=["cls", "tokens"])
                good = b.classes(row, token, n).view(np.int64) == out.column("cls").to_numpy()
                yield out.filter(pa.array(good))  # an id may have other texts as well

    return texts.mapInArrow(run, "cls long, tokens binary").dropDuplicates(["cls"])


def live_buckets(rows: DataFrame) -> DataFrame:
    """``(sig, cls, held, before)`` of buckets with two classes or more.

    ``held`` is the number of the bucket's classes; ``before`` holds the smaller ones if it
    has at most ``LISTED``, else its smallest.
    """
    w = Window.partitionBy("sig").orderBy("cls")
    rows = rows.withColumn("last", F.lag("cls").over(w)).withColumn("next", F.lead("cls").over(w)).withColumn("head", F.first("cls").over(w))
    fresh = F.col("last").isNull() | (F.col("last") != F.col("cls"))
    other = (F.col("head") != F.col("cls")) | (F.col("next").isNotNull())
    rows = rows.where(fresh & other).select("sig", "cls", "head")  # still with classes that only meet themselves
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("held", F.count("*").over(whole).cast("int")).withColumn("less", F.collect_list("cls").over(w.rowsBetween(1 - LISTED, -1)))
    before = F.when(F.col("held") <= LISTED, F.col("less")).when(F.col("cls") != F.col("head"), F.array("head")).otherwise(F.array().cast("array<bigint>"))
    return rows.where("held > 1").select("sig", "cls", "held", before.alias("before"))


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of half as many bits is the exclusive or of its halves."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


class Sketches:
    """Sets of one bucket, their sketches in a matrix for each length."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray, percent: int):
        self.sizes, self.percent, self.raw = sizes, percent, sketches
        length = np.array([len(x) // 8 for x in sketches])
        self.groups = []
        for words in np.unique(length):
            own = np.flatnonzero(length == words)
            self.groups.append((own, np.frombuffer(b"".join(sketches[i] for i in own), dtype=np.uint64).reshape(len(own), words)))

    def gaps(self, sketch: bytes, n: int, wanted: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric differences with one set; -1 where the pair isn't wanted or can't be linked."""
        out = np.full(len(self.sizes), -1, dtype=np.int64)
        fit = wanted & (100 * np.minimum(self.sizes, n) >= self.percent * np.maximum(self.sizes, n))
        a = np.frombuffer(sketch, dtype=np.uint64)
        for own, matrix in self.groups:
            on = fit[own]
            if not on.any():
                continue
            own, rows = own[on], matrix[on]
            w = min(len(a), rows.shape[1])
            gap = np.bitwise_count(fold(a, w)[None, :] ^ fold(rows, w)).sum(1, dtype=np.int64)
            out[own] = np.where(gap <= most_errors(self.sizes[own] + n, self.percent), gap, -1)
        return out


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(a, b, gap)`` of the pairs that size and sketch allow."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("a", "b", "na", "nb", "sa", "sb")}
            one = np.ones(1, dtype=bool)
            gap = [int(Sketches([c["sb"][i]], np.array([c["nb"][i]]), percent).gaps(c["sa"][i], c["na"][i], one)[0]) for i in range(batch.num_rows)]
            keep = pa.array([g >= 0 for g in gap])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(gap, type=pa.int64())], names=["a", "b", "gap"]).filter(keep)

    n = classes.select("cls", "n")
    sized = pairs.select("a", "b").join(n.select(F.col("cls").alias("a"), F.col("n").alias("x")), "a").join(n.select(F.col("cls").alias("b"), F.col("n").alias("y")), "b")
    fit = sized.where(100 * F.least("x", "y") >= percent * F.greatest("x", "y")).select("a", "b")
    return fit.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, gap long")


def block_cells(placed: DataFrame, crowds: DataFrame | None = None) -> DataFrame:
    """Rows ``(sig, cls, comp, one, two, block, crowd)`` of the buckets with several components, from ``(sig, cls, comp)``.

    A bucket's classes are dealt to blocks by hash; each pair of blocks ``one <= two`` is a
    cell, to which both blocks go.  ``crowds`` are ``(sig, least)``: buckets whose sets are
    compared whole, and how many blocks these need at least.
    """
    if crowds is None:
        crowds = placed.sparkSession.createDataFrame([], "sig long, least int")
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("held")).where("low <> high")
    blocks = F.greatest(F.ceil(F.col("held") / BLOCK).cast("int"), "least")
    mixed = mixed.join(crowds, "sig", "left").select("sig", blocks.alias("blocks"), F.col("least").isNotNull().alias("crowd"))
    rows = placed.join(mixed, "sig").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("sig", "cls", "comp", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "crowd")


def bucket_pairs(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows ``(a, b, gap, sig)`` from the classes ``(sig, one, two, block, cls, comp, n, sketch)`` of cells.

    Pairs ``a < b`` of different components in one cell that the sketch allows, without a
    ``sig``.  Classes of a cell's largest component meet only those of the others.

    * With ``tokens`` in the rows, these decide: the pairs are links that join components
      of the cell, true but for equal hashes of shingles.
    * With ``went`` in the rows, classes that went to one bucket with their tokens make no pair.
    * With neither, two classes of more than ``CROWD`` pairs each make no pair; such a class
      is a row with itself, its number of pairs as ``gap`` and the bucket.
    """
    extra = [c for c in ("tokens", "went") if c in rows.columns]

    def linked(a: bytes, b: bytes) -> bool:
        a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    def pairs(sig: int, block: np.ndarray, cls: list[int], comp: np.ndarray, size: np.ndarray, sketch: list[bytes], *more: list) -> Iterator[tuple[int, int, int, int | None]]:
        names, count = np.unique(comp, return_counts=True)
        largest = names[count.argmax()]
        cell, place, across = Sketches(sketch, size, percent), np.arange(len(comp)), block.min() != block.max()
        joined, met = comp.copy(), [frozenset(x or ()) for x in more[0]] if extra == ["went"] else None
        many, kept = np.zeros(len(comp), dtype=np.int64), []
        for i in np.flatnonzero(comp != largest):
            wanted = (joined != joined[i]) & ((comp == largest) | (place > i))
            if across:  # pairs within a block have a cell of their own
                wanted &= block != block[i]
            gap = cell.gaps(sketch[i], int(size[i]), wanted)
            found = np.flatnonzero(gap >= 0)
            if met and met[i] and len(found):
                found = found[[met[i].isdisjoint(met[j]) for j in found.tolist()]]
            if extra != ["tokens"]:
                many[i] += len(found)
                many[found] += 1
                kept.append((i, found, gap[found]))
                continue
            for j in found[np.argsort(gap[found], kind="stable")]:
                if joined[i] != joined[j] and linked(more[0][i], more[0][j]):
                    joined[joined == joined[j]] = joined[i]
                    yield (min(cls[i], cls[j]), max(cls[i], cls[j]), int(gap[j]), None)
        crowded = many > (CROWD if not extra else len(comp))
        for i, found, gap in kept:
            on = ~(crowded[i] & crowded[found])
            for j, g in zip(found[on].tolist(), gap[on].tolist()):
                yield (min(cls[i], cls[j]), max(cls[i], cls[j]), g, None)
        for i in np.flatnonzero(crowded):
            yield (cls[i], cls[i], int(many[i]), sig)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            for sig, one, two, *rest in zip(*(batch.column(c).to_pylist() for c in ("sig", "one", "two", "block", "cls", "comp", "n", "sketch", *extra))):
                if at != (sig, one, two):
                    if held:
                        yield at[0], held
                    at, held = (sig, one, two), []
                held.append(rest)
        if held:
            yield at[0], held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int, int, int | None]] = set()

        def rows_out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], names=["a", "b", "gap", "sig"])

        for sig, held in cells(batches):
            block, cls, comp, size, sketch, *more = zip(*held)
            comp = np.array(comp)
            if (comp == comp[0]).all():
                continue
            for pair in pairs(sig, np.array(block), list(cls), comp, np.array(size), list(sketch), *more):
                out.add(pair)
                if len(out) >= 50_000:
                    yield rows_out()
                    out.clear()
        if out:
            yield rows_out()

    cell = ["sig", "one", "two"]
    rows = rows.select(*cell, "block", "cls", "comp", "n", "sketch", *extra).repartition(n, *cell).sortWithinPartitions(*cell)
    return rows.mapInArrow(run, "a long, b long, gap long, sig long")


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int, salt: int = 0) -> DataFrame:
    """The ``(a, b)`` whose texts' sets, compared word by word, are within the threshold; ``texts`` has ``(cls, text)``.

    Each side picks its texts from the saved pairs by itself; the two then meet by pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = SetBuilder(size, percent, salt)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                good = np.ones(batch.num_rows, dtype=bool)
                for column, c in (("ta", "a"), ("tb", "b")):  # an id may have other texts as well
                    good &= b.classes(*b.sets(*utf8(batch.column(column)))).view(np.int64) == batch.column(c).to_numpy()
                for i in np.flatnonzero(good):
                    one, two, both = exact_overlap(*(batch.column(c)[int(i)].as_py().encode() for c in ("ta", "tb")), size)
                    good[i] = 100 * both >= percent * (one + two - both)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    one = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")).join(pairs.select("a", "b"), "a")
    two = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")).join(pairs.select("a", "b"), "b")
    return one.join(two, ["a", "b"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def class_texts(docs: DataFrame, known: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(cls, text)`` of the wanted classes, a text for each row of their smallest id."""
    reps = scratch.save(known.select("cls", "rep").join(wanted.select("cls").distinct(), "cls"), f"{name}-reps")
    some = marked(docs.select("doc_id", "text"), F.col("doc_id"), reps, F.col("rep")).where("_maybe")
    return scratch.save(some.join(reps, F.col("doc_id") == F.col("rep")).select("cls", "text"), name)


def sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components; a class not in ``(cls, comp)`` is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("cls").alias(c), F.col("comp").alias(f"_{c}")), c, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def nearest(pairs: DataFrame) -> DataFrame:
    """Of ``(a, b, gap)`` the pair of each ``b`` with its nearest ``a``."""
    return pairs.groupBy("b").agg(F.min_by(F.col("a"), F.struct("gap", "a")).alias("a")).select("a", "b")


def join(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, salt: int = 0) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest id that links of ``percent`` Jaccard similarity reach, itself included."""
    spark = scratch.spark
    rows = scratch.save(class_rows(docs, size, percent, salt), "rows")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(some.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"), F.first("sketch").alias("sketch")), "classes")
    if not classes.where("low <> high").isEmpty():
        raise ValueError("two different sets have one hash: join with another salt")
    live = scratch.save(live_buckets(signature_rows(docs, size, percent, salt)), "live")
    known = scratch.save(live.select("cls").distinct().join(classes.drop("low", "high"), "cls"), "known")
    listed = live.select(F.explode("before").alias("a"), F.col("cls").alias("b")).distinct()
    fit = scratch.save(possible(listed, known, percent), "fit")
    tested = scratch.save(nearest(fit), "tested-0")
    texts = class_texts(docs, known, sides(tested), scratch, "texts-0")
    links = scratch.save(verify(tested, texts, size, percent, salt), "links-0")

    def comps(tag: str) -> DataFrame:
        return components(scratch, links, tag).select(F.col("node").alias("cls"), F.col("root").alias("comp"))

    def cells(rows: DataFrame, found: DataFrame, least: DataFrame | None = None) -> DataFrame:
        placed = rows.select("sig", "cls").join(found, "cls", "left").select("sig", "cls", F.coalesce("comp", "cls").alias("comp"))
        return block_cells(placed, least).join(known.select("cls", "n", "sketch"), "cls")

    found = comps("part-1")
    dealt = scratch.save(bucket_pairs(cells(live.where(F.col("held") > LISTED), found), partitions(spark), percent), "dealt")
    marks = scratch.save(dealt.where("sig is not null").select("sig", F.col("a").alias("cls")).distinct(), "marks")
    fullest = Window.partitionBy("cls").orderBy(F.desc("held"), "sig")
    counted = marks.join(marks.groupBy("sig").agg(F.count("*").alias("held")), "sig")
    attended = scratch.save(counted.withColumn("place", F.row_number().over(fullest)).where(F.col("place") <= ATTENDED).select("cls", "sig"), "attended")
    went = attended.groupBy("cls").agg(F.collect_list("sig").alias("went"))
    left = fit.unionByName(dealt.where("sig is null").select("a", "b", "gap")).groupBy("a", "b").agg(F.min("gap").alias("gap")).join(tested, ["a", "b"], "left_anti")
    left = scratch.save(apart(left, found), "left")
    rest = left.join(went.select(F.col("cls").alias("a"), F.col("went").alias("_x")), "a", "left").join(went.select(F.col("cls").alias("b"), F.col("went").alias("_y")), "b", "left")
    rest = scratch.save(rest.where("not coalesce(arrays_overlap(_x, _y), false)").select("a", "b", "gap"), "rest")
    texts = class_texts(docs, known, sides(left).unionByName(marks.select("cls")), scratch, "texts-1")
    crowd_texts = texts.join(attended.select("cls").distinct(), "cls")
    sets = scratch.save(class_sets(crowd_texts.select("cls", "text"), size, percent, salt), "sets")
    room = attended.join(known.select("cls", "n"), "cls").groupBy("sig").agg(F.ceil(F.sum("n") / ROOM).cast("int").alias("least"))
    for turn in (1, 2, 3):
        if turn == 1:
            made = bucket_pairs(cells(attended, found, room).join(sets, "cls"), partitions(spark), percent).select("a", "b").distinct().withColumn("sure", F.lit(True))
            pairs = nearest(rest).join(made, ["a", "b"], "left_anti").withColumn("sure", F.lit(False)).unionByName(made)
        else:
            found = comps(f"part-{turn}")
            known_to_meet = went if turn == 2 else went.where("false")
            made = bucket_pairs(cells(marks, found).join(known_to_meet, "cls", "left"), partitions(spark), percent).select("a", "b")
            pairs = apart(rest if turn == 2 else left, found).select("a", "b").unionByName(made).distinct().join(tested, ["a", "b"], "left_anti").withColumn("sure", F.lit(False))
        pairs = scratch.save(pairs.select("a", "b", "sure"), f"tested-{turn}")
        true = scratch.save(verify(pairs, texts, size, percent, salt), f"links-{turn}")
        if turn == 1:
            again = not pairs.where("sure").join(true, ["a", "b"], "left_anti").isEmpty()
        links, tested = links.unionByName(true), tested.unionByName(pairs.select("a", "b"))
        if turn == 2 and not again:
            break
    found = components(scratch, links, "whole").select(F.col("node").alias("cls"), "root")
    scratch.drop("live", "known", "fit", "dealt", "marks", "attended", "left", "rest", "sets", *(f"{name}-{k}" for name in ("texts", "tested", "links") for k in range(turn + 1)), "texts-0-reps", "texts-1-reps")
    reps = found.join(classes.select("cls", "rep"), "cls")
    names = reps.groupBy("root").agg(F.min("rep").alias("least")).join(found, "root").select("cls", "least")
    final = classes.select("cls", "rep").join(names, "cls", "left").select("cls", F.coalesce("least", "rep").alias("component_id"))
    out = some.select("doc_id", "n_shingles", "cls").join(final, "cls").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
