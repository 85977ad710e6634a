"""Media columns in Ogg: a multiplexer and a verifying demultiplexer for 8-bit samples.

A payload becomes two logical streams whose data packets alternate.  Each stream
starts with a page of its own that holds an identification packet; packets are cut
into lacing values, pages carry a checksum, a sequence number and the granule
position (samples so far) of the last packet that ends on them.

Null texts are empty; the payload is padded with zero bytes to a positive multiple of
64.  Equal texts give equal bytes.  Any damaged byte raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAD = 64
PACKET = 4080  # samples: 16 lacing values of 255 and a closing 0
RATE = 8000
SERIALS = (0x5354524C, 0x53545252)
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIII B".replace(" ", ""))
IDENT = struct.Struct("<8sIIQ")
MAGIC = b"\x7fSAMPLE8"
REFLECT = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """The container's CRC-32 (polynomial 04C11DB7, most significant bit first, register from 0).

    Bit-reflecting the bytes in, and the register out, lets the usual reflected
    routine do the work.
    """
    register = zlib.crc32(page.translate(REFLECT), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(REFLECT), "big")


def laces(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


class StreamWriter:
    """Packs one logical stream's packets into pages of at most 255 lacing values."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> bytes:
        head = HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.sequence, 0, len(lacing))
        self.sequence += 1
        crc = page_checksum(head + lacing + body)
        return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body

    def pages(self, packets: list[tuple[bytes, int]], flags: int = 0, last: bool = False) -> Iterator[bytes]:
        """packets: (bytes, granule position at its end)."""
        lacing, ends = bytearray(), []
        for packet, granule in packets:
            lacing += laces(len(packet))
            ends.append((len(lacing), granule))
        body, at, byte, k = b"".join(p for p, _ in packets), 0, 0, 0
        continued = 0
        while at < len(lacing):
            own = bytes(lacing[at : at + 255])
            size, granule = sum(own), -1  # -1: no packet ends here
            while k < len(ends) and ends[k][0] <= at + len(own):
                granule, k = ends[k][1], k + 1
            at += len(own)
            yield self.page(own, body[byte : byte + size], granule, flags | continued | LAST * (last and at == len(lacing)))
            byte += size
            continued = CONTINUED * (own[-1] == 255)


def encode(payload: bytes, rate: int = RATE) -> bytes:
    writers = [StreamWriter(s) for s in SERIALS]
    split = [[], []]
    for i in range(0, len(payload), PACKET):
        split[i // PACKET % 2].append(payload[i : i + PACKET])
    out = []
    for w, packets in zip(writers, split):
        out += w.pages([(IDENT.pack(MAGIC, rate, PACKET, sum(map(len, packets))), 0)], FIRST)
    queues = []
    for w, packets in zip(writers, split):
        done, timed = 0, []
        for p in packets or [b""]:
            done += len(p)
            timed.append((p, done))
        queues.append(list(w.pages(timed, last=True)))
    for i in range(max(map(len, queues))):
        out += [q[i] for q in queues if i < len(q)]
    return b"".join(out)


@dataclass
class Stream:
    rate: int = 0
    samples: int = 0
    packets: list[bytes] = field(default_factory=list)
    #: Seconds at which each packet ends.
    times: list[float] = field(default_factory=list)
    pages: int = 0


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Verifies every page and gives each logical stream's data packets with their timestamps."""
    streams: dict[int, Stream] = {}
    open_packets: dict[int, bytes] = {}
    ended: set[int] = set()
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise ValueError("truncated page header")
        mark, version, flags, granule, serial, sequence, crc, n = HEAD.unpack_from(data, at)
        start = at + HEAD.size
        lacing = data[start : start + n]
        size = sum(lacing)
        end = start + n + size
        if mark != b"OggS" or version or len(lacing) < n or end > len(data):
            raise ValueError("not a page, or truncated")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"bad checksum in page {sequence} of stream {serial}")
        s = streams.get(serial)
        if (s is None) != bool(flags & FIRST) or serial in ended or sequence != (s.pages if s else 0):
            raise ValueError(f"page {sequence} of stream {serial} is out of order")
        s = streams.setdefault(serial, Stream())
        if bool(flags & CONTINUED) != (serial in open_packets):
            raise ValueError(f"broken continuation in stream {serial}")
        s.pages += 1
        byte, run, fresh = start + n, open_packets.pop(serial, b""), []
        length = 0
        for value in lacing:
            length += value
            if value < 255:
                fresh.append(run + data[byte : byte + length])
                byte, run, length = byte + length, b"", 0
        if lacing and lacing[-1] == 255:
            open_packets[serial] = run + data[byte : byte + length]
        if flags & FIRST:
            magic, s.rate, _, s.samples = IDENT.unpack(fresh.pop(0))
            if magic != MAGIC:
                raise ValueError("unknown codec")
        position = granule - sum(map(len, fresh))
        for p in fresh:
            position += len(p)
            s.packets.append(p)
            s.times.append(position / s.rate)
        if flags & LAST:
            ended.add(serial)
        at = end
    if open_packets or ended != set(streams):
        raise ValueError("a stream doesn't end")
    for s in streams.values():
        if sum(map(len, s.packets)) != s.samples:
            raise ValueError("samples are missing")
    return streams


def decode(data: bytes) -> tuple[bytes, dict[int, Stream]]:
    streams = demultiplex(data)
    a, b = (streams[s].packets for s in SERIALS)
    turns = [p for pair in zip(a, b) for p in pair] + a[len(b) :]
    return b"".join(turns), streams


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def feature(payload: bytes, streams: dict[int, Stream]) -> str:
    """What the container says (pages, packets, last timestamp) and two measures of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    last = max(s.times[-1] for s in streams.values())
    return f"pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};last_us={round(last * 1e6)};sum={int(x.sum())};power={int((x * x).sum())}"


COLUMNS = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())])


def describe(text: bytes) -> tuple:
    media = encode(padded(text))
    payload, streams = decode(media)
    return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, streams), media)


def media_columns(df: DataFrame, text: str = "text", with_media: bool = True) -> DataFrame:
    """Adds the stored form of ``text`` (``media``) and what is read back from it; input columns of these names are replaced."""
    schema = COLUMNS if with_media else COLUMNS.remove(len(COLUMNS) - 1)
    keep = [c for c in df.columns if c not in schema.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = [describe(x.as_py() or b"")[: len(schema)] for x in part.column(text).cast(pa.large_binary())]
                made = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *schema.names])

    out = df.select(*keep).schema
    for f in schema:
        out = out.add(f.name, "string" if f.type == pa.string() else "binary" if f.type == pa.binary() else "long")
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, out)
