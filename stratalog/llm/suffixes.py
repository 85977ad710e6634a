"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified by comparison with their right neighbour; the substrings that
start at leftmost smaller suffixes are sorted by one induction, named, and sorted
as a text of names where these repeat; a second induction yields the whole array.  An
induction over a small alphabet handles a bucket of the first symbol at a time: what it
sends to other buckets keeps its order, so a stable sort by symbol places a whole bucket
at once.  Few names are sorted by recursion, many by doubling the compared prefix, which
takes as many sorts as the longest repeat has binary digits, each of what is still equal.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the last, a sentinel, counts as smaller."""
    n = len(t)
    step = np.sign(np.diff(t))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.ones(n, dtype=bool)
    inside = following < n
    smaller[:-1][inside] = step[following[inside]] > 0
    return smaller


def induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that sorted leftmost smaller suffixes induce."""
    if symbols <= SMALL_ALPHABET:
        return induce_by_bucket(t, smaller, seeds, symbols)
    return induce_by_suffix(t, smaller, seeds, symbols)


def scatter(sa: np.ndarray, at: np.ndarray, symbol: np.ndarray, suffix: np.ndarray, symbols: int, down: bool) -> None:
    """Appends suffixes to their symbols' buckets in order; ``at`` are the next free places."""
    order = np.argsort(symbol, kind="stable")
    symbol, suffix = symbol[order], suffix[order]
    count = np.bincount(symbol, minlength=symbols)
    rank = np.arange(len(symbol)) - (np.cumsum(count) - count)[symbol]
    if down:
        sa[at[symbol] - rank] = suffix
        at -= count
    else:
        sa[at[symbol] + rank] = suffix
        at += count


def induce_by_bucket(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    n = len(t)
    count = np.bincount(t, minlength=symbols)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, dtype=np.int64)
    head = start.copy()
    by_symbol = np.argsort(t[seeds], kind="stable")
    sown = seeds[by_symbol]
    sown_end = np.cumsum(np.bincount(t[seeds], minlength=symbols))
    for c in range(symbols):  # larger suffixes, upwards
        done = start[c]
        while done < head[c]:  # those within the bucket, a wave for each repetition of the symbol
            before = sa[done : head[c]] - 1
            done = head[c]
            before = before[before >= 0]
            before = before[(t[before] == c) & ~smaller[before]]
            sa[head[c] : head[c] + len(before)] = before
            head[c] += len(before)
        own = np.concatenate([sa[start[c] : head[c]], sown[sown_end[c - 1] if c else 0 : sown_end[c]]]) - 1
        own = own[own >= 0]
        own = own[~smaller[own] & (t[own] > c)]
        if len(own):
            scatter(sa, head, t[own], own, symbols, False)
    tail = end - 1
    for c in range(symbols - 1, -1, -1):  # smaller suffixes, downwards
        done = end[c] - 1
        while done > tail[c]:
            before = sa[tail[c] + 1 : done + 1][::-1] - 1
            done = tail[c]
            before = before[before >= 0]
            before = before[(t[before] == c) & smaller[before]]
            sa[tail[c] - len(before) + 1 : tail[c] + 1] = before[::-1]
            tail[c] -= len(before)
        own = np.concatenate([sa[tail[c] + 1 : end[c]][::-1], sa[start[c] : head[c]][::-1]]) - 1
        own = own[own >= 0]
        own = own[smaller[own] & (t[own] < c)]
        if len(own):
            scatter(sa, tail, t[own], own, symbols, True)
    sa[0] = n - 1
    return sa


def induce_by_suffix(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    n = len(t)
    count = np.bincount(t, minlength=symbols)
    end = np.cumsum(count)
    head, tail = (end - count).tolist(), (end - 1).tolist()
    text, small = t.tolist(), smaller.tolist()
    sa = [-1] * n
    for i in reversed(seeds.tolist()):
        sa[tail[text[i]]] = i
        tail[text[i]] -= 1
    for k in range(n):
        i = sa[k] - 1
        if i >= 0 and not small[i]:
            c = text[i]
            sa[head[c]] = i
            head[c] += 1
    tail = (end - 1).tolist()
    for k in range(n - 1, -1, -1):
        i = sa[k] - 1
        if i >= 0 and small[i]:
            c = text[i]
            sa[tail[c]] = i
            tail[c] -= 1
    sa[0] = n - 1
    return np.array(sa, dtype=np.int64)


def name_substrings(t: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of sorted substrings: equal ones share one.  All symbols are compared."""
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    a, b = a[same], b[same]
    size = length[a]
    equal = np.zeros(len(ordered) - 1, dtype=bool)
    if len(a):
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        match = t[np.repeat(a, size) + step] == t[np.repeat(b, size) + step]
        equal[same] = np.logical_and.reduceat(match, first)
    return np.concatenate([[0], np.cumsum(~equal)])


def doubled(names: np.ndarray) -> np.ndarray:
    """The sorted suffixes of a text that ends with its only 0, by ranks of prefixes of 1, 2, 4 and so on symbols."""
    order = np.argsort(names, kind="stable")
    key, rank = names[order], np.empty(len(names), dtype=np.int64)
    suffix, at, step = order, np.arange(len(names)), 1
    while True:
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(fresh, at, 0))
        at = at[~(fresh & np.concatenate([fresh[1:], [True]]))]
        if not len(at):
            return order
        suffix = order[at]  # equal prefixes don't hold the end, so a symbol follows
        key = rank[suffix] * len(names) + rank[suffix + step]
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[at] = suffix
        step *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the sorted suffixes of ``text`` (integers from 0 below ``symbols``)."""
    if not len(text):
        return np.zeros(0, np.int64)
    return sorted_suffixes(np.concatenate([text.astype(np.int64) + 1, [0]]), symbols + 1)[1:]


def sorted_suffixes(t: np.ndarray, symbols: int) -> np.ndarray:
    """As :func:`suffix_array`, of a text that ends with its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = classify(t)
    leftmost = smaller.copy()
    leftmost[0] = False
    leftmost[1:] &= ~smaller[:-1]
    places = np.flatnonzero(leftmost)
    if len(places) == 1:
        return induce(t, smaller, places, symbols)
    rough = induce(t, smaller, places, symbols)
    ordered = rough[leftmost[rough]]
    length = np.zeros(n, dtype=np.int64)
    length[places[:-1]] = np.diff(places) + 1
    length[places[-1]] = 1
    names = name_substrings(t, ordered, length)
    if names[-1] + 1 < len(places):
        reduced = np.zeros(n, dtype=np.int64)
        reduced[ordered] = names
        few = names[-1] < SMALL_ALPHABET
        ordered = places[sorted_suffixes(reduced[places], int(names[-1]) + 1) if few else doubled(reduced[places])]
    return induce(t, smaller, ordered, symbols)


def common_prefixes(data: np.ndarray, room: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix of its suffix and the one before it in ``sa``, within both their ``room``.

    Only irreducible positions, whose left symbols differ from their neighbours', are
    compared; along the text each other value is one less than the one on its left.
    """
    n = len(data)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    left, right = np.maximum(at - 1, 0), np.maximum(phi - 1, 0)
    bare = (phi <= 0) | (at == 0) | (data[left] != data[right]) | (room[left] == 0) | (room[right] == 0)
    where = np.flatnonzero(bare)
    value = np.zeros(len(where), dtype=np.int64)
    have = np.flatnonzero(phi[where] >= 0)
    a, b = where[have], phi[where[have]]
    most = np.minimum(room[a], room[b])
    value[have] = np.minimum(matching(data, a, b, most), most)
    last = np.maximum.accumulate(np.where(bare, at, 0))
    rank = np.cumsum(bare) - 1
    return np.maximum(value[rank] - (at - last), 0)


def matching(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes at pairs of positions, eight bytes at a time; right up to ``most``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8")[:, 0]
    out = np.zeros(len(a), dtype=np.int64)
    open_ = np.flatnonzero(most > 0)
    done = 0
    while len(open_):
        x = eight[a[open_] + done] ^ eight[b[open_] + done]
        differ = x != 0
        low = x[differ]
        out[open_[differ]] = done + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        open_ = open_[~differ]
        done += 8
        out[open_] = done
        open_ = open_[most[open_] > done]
    return out
