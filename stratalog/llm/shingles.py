"""Word shingles of whole texts as 64-bit hashes, for many texts at once in numpy."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from .common import mix64, mix_int

#: ASCII white space, the only bytes that part words.
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed in one go; a longer word is hashed by itself.
SEGMENT = 1 << 17
WORDS_MAX = 16
FACTORS = [np.uint64(mix_int(100 + i) | 1) for i in range(WORDS_MAX)]
SHORT = [np.uint64(mix_int(200 + i)) for i in range(WORDS_MAX)]
LENGTH = np.uint64(mix_int(3) | 1)


#: A-Z count as a-z.
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
PLACE = np.uint64(mix_int(17) | 1)


class WordHasher:
    """A word's hash is the sum of its bytes' hashes, each mixed with its place in the word: no pattern of bytes makes collisions likelier."""

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and each one's row; ``offsets`` start at 0."""
        gap = GAP[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= gap[:-1]
        after[:-1] |= gap[1:]
        start, end = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
        row = np.searchsorted(offsets, start, side="right") - 1
        out = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(start):
            j = int(np.searchsorted(end, start[i] + SEGMENT, side="right"))
            if j <= i:
                word = data[start[i] : end[i]].tobytes().lower()
                out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                i += 1
                continue
            size = end[i:j] - start[i:j]
            first = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(first, size)
            code = LOWER[data[np.repeat(start[i:j], size) + place]] + (place.astype(np.uint64) << np.uint64(8))
            out[i:j] = np.add.reduceat(mix64((code + np.uint64(1)) * PLACE), first)
            i = j
        return mix64(out + (end - start).astype(np.uint64) * LENGTH), row


def shingle_sets(words: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles: (row, hash), sorted by both.

    A row with fewer words than ``size`` has its whole sequence as one shingle; one
    without words has none.
    """
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    hashes, owners = [], []
    if len(words) >= size:
        full = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1])
        h = np.zeros(len(full), dtype=np.uint64)
        for i in range(size):
            h += words[full + i] * FACTORS[i]
        hashes.append(h)
        owners.append(row[full])
    for n in range(1, size):
        own = np.flatnonzero(count == n)
        if len(own):
            h = np.full(len(own), SHORT[n], dtype=np.uint64)
            for i in range(n):
                h += words[first[own] + i] * FACTORS[i]
            hashes.append(h)
            owners.append(own)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, owner = mix64(np.concatenate(hashes)), np.concatenate(owners).astype(np.int64)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], h[fresh]


WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def exact_overlap(a: bytes, b: bytes, size: int) -> tuple[int, int, int]:
    """Sizes of two texts' sets of shingles and of their intersection, by the words themselves."""
    numbers: dict[bytes, int] = {}
    columns = []
    for text in (a, b):
        words = np.array([numbers.setdefault(w, len(numbers) + 1) for w in WORDS.findall(text.lower())], dtype=np.int64)
        if 0 < len(words) < size:  # the whole sequence; 0 is no word
            words = np.concatenate([words, np.zeros(size - len(words), np.int64)])
        columns.append([words[i : len(words) - size + 1 + i] for i in range(size)] if len(words) else [words] * size)
    code = np.concatenate([c[0] for c in columns])
    for i in range(1, size):
        _, code = np.unique(code * (len(numbers) + 1) + np.concatenate([c[i] for c in columns]), return_inverse=True)
    split = len(columns[0][0])
    one, two = np.unique(code[:split]), np.unique(code[split:])
    return len(one), len(two), len(np.intersect1d(one, two, assume_unique=True))
