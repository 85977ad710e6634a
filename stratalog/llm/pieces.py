"""SentencePiece encoding and decoding on the tokenizers library.

A model's protobuf is parsed here (no protobuf library), its normaliser, metaspace
marker, scores or merge order, and byte fallback are rebuilt as a fast tokenizer, and
batches are encoded at once.  Unigram models keep their scores; BPE models get a
merge list in score order.  :func:`parity` compares with the sentencepiece library.

Null texts encode to null and decode to null, empty texts to no ids.  Special tokens
written out in a text are ordinary text.  Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protobuf message; floats come as their four bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} isn't supported")
            size = varint()
        if at + size > len(data):
            raise ValueError("truncated message")
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    suffix_spaces: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.suffix_spaces = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
                elif n == 44:
                    m.unk_surface = v.decode()
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze_spaces = bool(v)
                elif n == 5:
                    m.escape_spaces = bool(v)
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models")
    if m.suffix_spaces or not m.escape_spaces:
        raise ValueError("the space marker must be a prefix")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Every way to make a piece out of two others, best piece first; special and byte pieces take no part."""
    rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, score, kind in m.pieces:
        if kind in (NORMAL, USER_DEFINED):
            ways = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
            found += [(-score, rank[piece], rank[a], rank[b], (a, b)) for a, b in ways]
    return [x[-1] for x in sorted(found)]


def build(m: Model):
    """The tokenizers library's form of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

    if m.kind == UNIGRAM:
        low = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0)
        t = Tokenizer(models.Unigram([(p, s if k == NORMAL else low - 1e6) for p, s, k in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback))
    else:
        t = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0))
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if steps:  # else Codec.mark does the rest, which is cheaper than to track offsets through normalisers
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    special = [AddedToken(p, normalized=False, special=False) for p, _, k in m.pieces if k == USER_DEFINED]
    if special:
        t.add_tokens(special)
    return t


class Codec:
    def __init__(self, data: bytes):
        self.model = parse(data)
        self.tokenizer = build(self.model)
        self.by_id: list[bytes] = []
        for p, _, k in self.model.pieces:
            self.by_id.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else self.model.unk_surface.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode())

    def mark(self, text: str) -> str:
        if self.tokenizer.normalizer is not None or not text:
            return text
        return SPACE * self.model.dummy_prefix + text.replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a batch; the library spreads it over its threads (one unless RAYON_NUM_THREADS says more)."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(list(map(self.mark, texts)), add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.by_id.__getitem__, ids))
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def use_threads(n: int) -> None:
    if n > 1:
        os.environ.setdefault("RAYON_NUM_THREADS", str(n))
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if n > 1 else "false"


@lru_cache(maxsize=2)
def loaded(data: bytes) -> Codec:
    return Codec(data)


@lru_cache(maxsize=2)
def library(data: bytes):
    """The sentencepiece library's processor of a model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def codec(data: bytes, threads: int = 1) -> Codec:
    use_threads(threads)
    return loaded(data)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def checked(text: str, share: int) -> bool:
    """One text in ``share``, by its CRC-32."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % share == 0


def encode(df: DataFrame, model: bytes, text: str = "text", threads: int | None = None, check_round_trip: bool = False, parity_share: int = 0) -> DataFrame:
    """Adds ``ids`` (array of int) and, if asked for, ``round_trip`` (decoding gives the text back) and ``parity``; clashing input columns are replaced.

    ``parity`` says of one text in ``parity_share`` whether the sentencepiece library gives
    the same ids, and is null for the others.  ``model`` is the file's content, broadcast
    once; it is of a fixed size.  Batches are encoded by as many ``threads`` as a task has
    cores (``spark.task.cpus``) unless it is given.
    """
    made = ["ids", *["round_trip"] * check_round_trip, *["parity"] * (parity_share > 0)]
    keep = [c for c in df.columns if c not in made]
    threads = threads or int(df.sparkSession.conf.get("spark.task.cpus", "1"))
    sent = df.sparkSession.sparkContext.broadcast(base64.b64encode(model).decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(base64.b64decode(sent.value), threads)
        theirs = library(base64.b64decode(sent.value)) if parity_share else None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(text).to_pylist()
                some = iter(c.encode([x for x in texts if x is not None]))
                ids = [None if x is None else next(some) for x in texts]
                cols = [pa.array(ids, type=pa.list_(pa.int32()))]
                if check_round_trip:
                    cols.append(pa.array([None if x is None else c.decode(i) == x for x, i in zip(texts, ids)], type=pa.bool_()))
                if parity_share:
                    same = [theirs.encode(x) == i if x is not None and checked(x, parity_share) else None for x, i in zip(texts, ids)]
                    cols.append(pa.array(same, type=pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *cols], names=[*keep, *made])

    schema = df.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))
    if check_round_trip:
        schema = schema.add("round_trip", "boolean")
    if parity_share:
        schema = schema.add("parity", "boolean")
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``; null ids give null."""
    keep = [c for c in df.columns if c != out]
    sent = df.sparkSession.sparkContext.broadcast(base64.b64encode(model).decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(base64.b64decode(sent.value))
        for batch in batches:
            text = [None if x is None else c.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(text, type=pa.string())], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, df.select(*keep).schema.add(out, "string"))


def parity(model_path: str, texts: list[str]) -> list[int]:
    """Positions of the texts that the sentencepiece library encodes to other ids."""
    data = read_model(model_path)
    theirs = library(data).encode(texts, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(codec(data).encode(texts), theirs)) if a != b]
