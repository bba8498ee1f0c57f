"""Word shingles of Arrow texts as 64-bit hashes, computed on whole batches in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lacuna.llm.arrow import utf8

WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, many: int) -> np.ndarray:
    """base^0 … base^(many-1) modulo 2^64, kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < many:
        have = np.full(max(many, 1 << 20), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:many]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, from sums of powers over the whole batch."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `words` words, lower-cased; a text with fewer words is one run, without any none.

    A word is a run of ASCII letters and digits and of characters beyond ASCII.
    """
    data, at = utf8(pc.utf8_lower(column))
    inside = _WORD_BYTE[data]
    before = np.concatenate([[False], inside[:-1]])
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[at[1:][at[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    word = word_hashes(data, starts, ends)
    row = np.searchsorted(at, starts, "right") - 1
    many = np.bincount(row, minlength=len(column))
    first = np.concatenate([[0], np.cumsum(many)])[:-1]
    runs = np.where(many > 0, np.maximum(many - words + 1, 1), 0)
    out_row = np.repeat(np.arange(len(column)), runs)
    place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + first[out_row]
    total = np.zeros(len(place), np.uint64)
    last = (first + many)[out_row]
    for k in range(words):
        there = place + k
        ok = there < last
        total = total * np.uint64(0xC2B2AE3D27D4EB4F)
        total[ok] += word[there[ok]]
    return out_row, mix(total)


def counted(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, times) of distinct values, sorted by row and value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))
