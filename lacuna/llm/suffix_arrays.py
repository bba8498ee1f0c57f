"""Suffix arrays by Larsson-Sadakane refinement, common prefixes by Kasai, and lookups between arrays by binary search.

All on numpy arrays of one shard.
"""

from __future__ import annotations

import numpy as np


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(words: np.ndarray, reach: int = 8) -> np.ndarray:
    """Positions sorted by what follows. `words`: packed bytes, or other numbers that each stand for `reach` symbols.

    After the first sort by these, ranks are doubled in reach: only suffixes in groups that are not yet sorted are
    sorted again, by the rank of what follows; the rank of a suffix is the place of its group.
    """
    size = len(words)
    order = np.argsort(words, kind="stable") if size < 1000 else np.argsort(words)
    key = words[order]
    new = np.ones(size, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(size + 1, np.int64)  # beyond the end: below all others
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, size))) + 1
    while True:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        own = order[open_]
        key = rank[own] * np.int64(size + 2) + rank[np.minimum(own + reach, size)]
        sub = np.argsort(key)
        own, key = own[sub], key[sub]
        order[open_] = own
        split = np.ones(len(own), bool)
        split[1:] = key[1:] != key[:-1]
        new[open_] = split
        places = open_[split]
        rank[own] = np.repeat(places, np.diff(np.append(np.flatnonzero(split), len(own)))) + 1
        reach *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of `order`, how many bytes its suffix shares with the one before it, `depth` at most.

    `order` holds all suffixes in sorted order, or some of them. Kasai's bound in text order: a suffix shares at least
    one byte less than the suffix one position before it did, if the partner of that one, moved on, is in the array too.
    Every eighth position is compared from the start, the others go on from that bound, each step for all at once.
    """
    size = len(words)
    before = np.full(size + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    there = np.zeros(size + 1, bool)
    there[order] = True
    shared = np.zeros(size, np.int64)
    for phase in range(8):
        at = np.arange(phase, size, 8)
        at = at[before[at] >= 0]
        length = np.where(there[before[at - 1] + 1], np.maximum(shared[at - 1] - 1, 0), 0) if phase else np.zeros(len(at), np.int64)
        live = np.flatnonzero(length < depth)
        while len(live):
            a, b = at[live] + length[live], before[at[live]] + length[live]
            ok = (a < size) & (b < size)
            live, a, b = live[ok], a[ok], b[ok]
            differ = words[a] ^ words[b]
            same = differ == 0
            # Equal leading bytes of the two words.
            lead = np.full(len(live), 8, np.int64)
            lead[~same] = (63 - np.floor(np.log2(differ[~same].astype(np.float64))).astype(np.int64)) // 8
            # A float rounds up to the next power of two at times; the byte tells.
            wrong = ~same & (lead < 8)
            up = wrong.nonzero()[0]
            if len(up):
                top = (differ[up] >> ((np.uint64(7) - np.clip(lead[up], 0, 7).astype(np.uint64)) * np.uint64(8))) & np.uint64(255)
                lead[up] += top == 0
            length[live] += lead
            live = live[same & (length[live] < depth)]
        shared[at] = np.minimum(length, depth)
    out = shared[order]
    out[:1] = 0
    # Bytes beyond the end are zeros in the words; they do not count.
    ends = np.minimum(size - order, size - np.concatenate([order[:1], order[:-1]]))
    return np.minimum(out, ends)


def prefix_table(words: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` bytes from each position as rows of numbers that sort like the bytes."""
    columns = []
    for k in range(0, depth, 8):
        at = positions + k
        word = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], np.uint64(0))
        if depth - k < 8:
            word = word >> np.uint64(8 * (8 - depth + k))
        columns.append(word)
    return np.stack(columns, axis=1)


def search(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of the sorted table that equals each wanted row, or -1: binary search for all of them at once.

    The first numbers are searched alone; the others decide within the rows that share the first one.
    """
    found = np.full(len(wanted), -1, np.int64)
    if not len(table):
        return found
    low = np.searchsorted(table[:, 0], wanted[:, 0], "left")
    high = np.searchsorted(table[:, 0], wanted[:, 0], "right")
    live = np.flatnonzero(low < high)
    low, high, rows = low[live], high[live], wanted[live]
    while len(live):
        middle = (low + high) // 2
        there = table[middle]
        less, equal = np.zeros(len(live), bool), np.ones(len(live), bool)
        for k in range(1, table.shape[1]):
            less |= equal & (there[:, k] < rows[:, k])
            equal &= there[:, k] == rows[:, k]
        found[live[equal]] = middle[equal]
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        on = ~equal & (low < high)
        live, low, high, rows = live[on], low[on], high[on], rows[on]
    return found
