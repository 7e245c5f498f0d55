"""Suffix arrays over bytes in numpy: refinement, common prefixes, search."""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number (zeros behind the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of `data` sorted by their first `depth` bytes at least.

    Larsson and Sadakane's refinement: suffixes sorted by h bytes get the rank of
    their group; only groups of more than one are sorted further, by the ranks h
    bytes on, which sorts them by 2h bytes.
    """
    n = len(data)
    word = _words(data)
    order = np.argsort(word)
    word = word[order]
    first = np.concatenate(([True], word[1:] != word[:-1]))
    del word
    at = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, at, 0))
    h = 8
    while h < depth:
        alone = first & np.concatenate((first[1:], [True]))
        place = np.flatnonzero(~alone)
        if not len(place):
            break
        member = order[place]
        key = (rank[member] << 32) | (rank[np.minimum(member + h, n)] + 1)
        sort = np.argsort(key, kind="stable")
        member, key = member[sort], key[sort]
        order[place] = member
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first[place] = new
        rank[member] = np.maximum.accumulate(np.where(new, place, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each suffix in `order` how many bytes it shares with the one before it, counted up to `width`.

    Kasai's order of work: in text order, the length at i + 1 is one less than at i
    while the neighbours move on together. So bytes are compared only where such a
    run begins and every 64 places inside it, eight at a time for all runs at once.
    """
    n, step = len(data), 64
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    head = np.ones(n, bool)
    head[1:] = (before[1:] <= 0) | (before[:-1] != before[1:] - 1) | (data[:-1] != data[np.maximum(before[1:], 1) - 1])
    head[::step] = True
    heads = np.flatnonzero(head)
    heads = heads[before[heads] >= 0]
    word = _words(data)
    length = np.zeros(n, np.int64)
    active = heads
    for done in range(0, width + step, 8):
        i, j = active + done, before[active] + done
        inside = (i < n) & (j < n)
        length[active[~inside]] = done
        active, i, j = active[inside], i[inside], j[inside]
        differ = word[i] ^ word[j]
        same = differ == 0
        part = differ[~same]
        lead = np.zeros(len(part), np.int64)
        for b in range(1, 8):
            lead += part < np.uint64(1 << (64 - 8 * b))
        length[active[~same]] = done + lead
        active = active[same]
        if not len(active):
            break
    length[active] = width + step
    length[heads] = np.minimum(length[heads], n - np.maximum(heads, before[heads]))  # not the zeros behind the end
    begin = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    length = length[begin] - (np.arange(n) - begin)
    return np.clip(length, 0, width)[order]


def compare(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """-1, 0 or 1 as the `width` bytes of a at i lie before, at or behind those of b at j."""
    out = np.zeros(len(i), np.int8)
    open_ = np.arange(len(i))
    for t in range(0, width, 8):
        x, y = _at(a, i[open_] + t, min(8, width - t)), _at(b, j[open_] + t, min(8, width - t))
        out[open_] = np.where(x < y, -1, np.where(x > y, 1, 0))
        open_ = open_[x == y]
        if not len(open_):
            break
    return out


def _at(data: np.ndarray, i: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(i), np.uint64)
    for b in range(size):
        out = (out << np.uint64(8)) | data[i + b].astype(np.uint64)
    return out


def find(data: np.ndarray, sorted_starts: np.ndarray, other: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """Binary search: for each `width` bytes of `other` at `wanted` the place in `sorted_starts`
    (starts in `data`, by their `width` bytes, all different) of the same bytes, or -1."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sorted_starts))
    while (busy := np.flatnonzero(low < high)).size:
        middle = (low[busy] + high[busy]) // 2
        below = compare(data, sorted_starts[middle], other, wanted[busy], width) < 0
        low[busy] = np.where(below, middle + 1, low[busy])
        high[busy] = np.where(below, high[busy], middle)
    hit = np.flatnonzero(low < len(sorted_starts))
    out = np.full(len(wanted), -1)
    same = compare(data, sorted_starts[low[hit]], other, wanted[hit], width) == 0
    out[hit[same]] = low[hit[same]]
    return out
