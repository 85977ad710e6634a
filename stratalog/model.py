"""Schemas, options and errors."""

from __future__ import annotations

from dataclasses import dataclass

ENTRY = "key string, seq long, value string"
FILES = "level int, id long, size long, smallest string, largest string"
EDITS = "txn long, pos int, op int, level int, id long, size long, smallest string, largest string, complete boolean"

# Fixed values of the store's formats and planning rules.
CREATE, DELETE, BEGIN, END = 0, 1, 2, 3
NORMAL, COMPACTING, GC = 1, 2, 3
INLINE, POINTER = 1, 2
INLINE_LIMIT = 15
POINTER_BYTES = 13
LEVEL0_TRIGGER = 5
LEVEL1_BYTES = 1 << 20
LEVEL_GROWTH = 10
DEEPEST_FLUSH = 2


@dataclass(frozen=True)
class Options:
    """A store's limits in bytes, its number of levels and its key order."""

    memtable_size: int = 16384
    table_size: int = 16384
    block_size: int = 1024
    bloom_false_positive: float = 0.0
    max_levels: int = 7
    ordering: str = "bytes"


class StoreError(Exception):
    pass


class EmptyKey(StoreError, ValueError):
    pass


class KeyNotFound(StoreError, KeyError):
    pass


class ChecksumMismatch(StoreError, ValueError):
    pass
