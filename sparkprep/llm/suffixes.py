"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; the leftmost S of each run ends the
substrings that are sorted first. Their names make a shorter text, sorted recursively; all other suffixes are induced
from them in two linear scans. The scans go bucket by bucket (first symbol), all suffixes of a bucket at once; where
buckets are many and small, as in the recursion, they go suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a text for each bucket, below which the scans go suffix by suffix.
FEW = 512


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their right neighbour; the text's end counts as smaller than all."""
    n = len(text)
    step = np.empty(n, np.int8)
    step[:-1] = (text[:-1] > text[1:]).astype(np.int8) - (text[:-1] < text[1:])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] < 0


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes, sorted as far as the order of ``seeds`` (the leftmost S suffixes) says."""
    if len(text) >= FEW * symbols:
        return induce_buckets(text, small, seeds, symbols)
    return np.array(induce_singly(text.tolist(), small.tolist(), seeds.tolist(), symbols), np.int64)


def induce_buckets(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    size = np.bincount(text, minlength=symbols)
    ends = np.cumsum(size)
    starts = ends - size
    larger = np.bincount(text[~small], minlength=symbols)
    out = np.full(len(text), -1, np.int64)

    def place(found: np.ndarray, free: np.ndarray, way: int) -> None:
        """Puts suffixes, in the order of the scan, to the next free places of their buckets."""
        first = text[found]
        order = np.argsort(first, kind="stable")
        first = first[order]
        many = np.bincount(first, minlength=symbols)
        nth = np.arange(len(found)) - (np.cumsum(many) - many)[first]
        out[free[first] + way * nth] = found[order]
        free += way * many

    order = np.argsort(text[seeds], kind="stable")
    seeds = seeds[order]
    of_seed = np.searchsorted(text[seeds], np.arange(symbols + 1))
    used = np.flatnonzero(size)
    free = starts.copy()
    place(np.array([len(text) - 1]), free, 1)  # the suffix before the text's end
    for c in used.tolist():
        done = starts[c]
        while done < free[c]:
            before = out[done : free[c]] - 1
            done = free[c]
            place(before[(before >= 0) & ~small[before]], free, 1)
        if of_seed[c] < of_seed[c + 1]:
            place(seeds[of_seed[c] : of_seed[c + 1]] - 1, free, 1)
    free = ends - 1
    for c in used[::-1].tolist():
        done = ends[c] - 1
        while done > free[c]:
            before = out[free[c] + 1 : done + 1][::-1] - 1
            done = free[c]
            place(before[(before >= 0) & small[before]], free, -1)
        before = out[starts[c] : starts[c] + larger[c]][::-1] - 1
        place(before[(before >= 0) & small[before]], free, -1)
    return out


def induce_singly(text: list[int], small: list[bool], seeds: list[int], symbols: int) -> list[int]:
    size = [0] * (symbols + 1)
    for c in text:
        size[c + 1] += 1
    for c in range(symbols):
        size[c + 1] += size[c]
    out = [-1] * len(text)
    free = size[1:]
    for i in reversed(seeds):
        c = text[i]
        free[c] -= 1
        out[free[c]] = i
    free = size[:symbols]
    i = len(text) - 1
    out[free[text[i]]] = i
    free[text[i]] += 1
    for j in out:  # grows ahead of the scan
        if j > 0:
            i = j - 1
            if not small[i]:
                c = text[i]
                out[free[c]] = i
                free[c] += 1
    free = size[1:]
    for at in range(len(text) - 1, -1, -1):
        j = out[at]
        if j > 0:
            i = j - 1
            if small[i]:
                c = text[i]
                free[c] -= 1
                out[free[c]] = i
    return out


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of ``text`` (whole numbers below ``symbols``) in order."""
    if len(text) < 2:
        return np.arange(len(text))
    small = smaller_types(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(seeds):
        return induce(text, small, seeds, symbols)
    rough = induce(text, small, seeds, symbols)
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    ranked = rough[is_seed[rough]]
    names, many = name(text, seeds, ranked)
    if many < len(seeds):
        ranked = seeds[suffix_array(names, many)]
    return induce(text, small, ranked, symbols)


def name(text: np.ndarray, seeds: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """The reduced text: for each substring from a seed to the next its rank among the different ones, and their number."""
    nth = np.empty(len(text), np.int64)
    nth[seeds] = np.arange(len(seeds))
    order = nth[ranked]
    length = np.r_[np.diff(seeds) + 1, 0][order]  # the last one meets the text's end and equals no other
    same = np.r_[False, (length[1:] == length[:-1]) & (length[1:] > 0)]
    rows, at = np.flatnonzero(same), 0
    while len(rows):
        differ = text[ranked[rows] + at] != text[ranked[rows - 1] + at]
        same[rows[differ]] = False
        at += 1
        rows = rows[~differ & (length[rows] > at)]
    rank = np.cumsum(~same) - 1
    names = np.empty(len(seeds), np.int64)
    names[order] = rank
    return names, int(rank[-1]) + 1


def words_at(text: np.ndarray, past: int = 64) -> np.ndarray:
    """The eight bytes from every position on, as one number; past the end are zeros."""
    raw = np.concatenate([text, np.zeros(past + 8, np.uint8)])
    return np.ndarray((len(text) + past,), "<u8", raw, strides=(1,))


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for every position how many bytes its suffix shares with the one before it in ``order``.

    Where both suffixes follow the same byte, the value is one less than that of the position before; all others
    are compared, eight bytes at a time. ``text`` is bytes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    new = (i == 0) | (before <= 0)
    new[1:] |= text[:-1] != text[before[1:] - 1]
    shared = np.zeros(n, np.int64)
    words = words_at(text)
    a = np.flatnonzero(new & (before >= 0))
    b = before[a]
    while len(a):
        at = shared[a]
        left, right = a + at, b + at
        room = n - np.maximum(left, right)
        differ = words[left] ^ words[right]
        equal = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
        shared[a] += np.minimum(equal, room)
        go = (differ == 0) & (room > 8)
        a, b = a[go], b[go]
    last = np.maximum.accumulate(np.where(new, i, 0))
    return np.where(new, shared, shared[last] - (i - last))
