"""Words and word shingles of whole texts as hashes, with numpy over Arrow's own buffers.

Words are what ASCII white space separates, as they are spelled. A text is never cut: one that
is longer than a piece is hashed piece by piece, at word ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
SLICE_BYTES = 500_000  # texts handled at once, and bytes hashed at once
_R = 0x2545F4914F6CDD1D  # odd, so powers of it have an inverse modulo 2**64
_R_INVERSE = pow(_R, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\f\v")] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _table(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(SLICE_BYTES.bit_length() + 1, n.bit_length()))


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word; no word goes over an edge."""
    space = _SPACE[data]
    first = np.empty(len(data) + 1, bool)  # a word may begin here
    first[0] = first[-1] = True
    first[1:-1] = space[:-1]
    first[edges] = True
    starts = np.flatnonzero(first[:-1] & ~space)
    last = np.empty(len(data), bool)  # the byte is the last before a separator or an edge
    last[:-1] = space[1:] | first[1:-1]
    last[-1] = True
    ends = np.flatnonzero(last & ~space) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(_R, len(data))[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * _table(_R_INVERSE, len(data))[starts])


@dataclass
class Words:
    """Word hashes of some rows of a batch: row and line (from 0) of each word."""

    hashes: np.ndarray
    row: np.ndarray
    line: np.ndarray
    first_row: int
    n_rows: int
    n_lines: np.ndarray  # of each row; an empty text has one empty line


def words(column: pa.Array) -> Iterator[Words]:
    """Words of a string column, some rows at a time; null is the empty text."""
    column = column.cast(pa.large_string())
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        begin, end = int(offsets[at]), int(offsets[to])
        starts_of, hashes_of = [], []
        here = begin
        while here < end:  # one piece, unless a single text is longer than that
            stop = end
            if end - here > 2 * SLICE_BYTES:
                stop = here + SLICE_BYTES
                while stop < end:  # up to the next separator
                    ahead = np.flatnonzero(_SPACE[data[stop : stop + SLICE_BYTES]])
                    if len(ahead):
                        stop += int(ahead[0])
                        break
                    stop = min(end, stop + SLICE_BYTES)
            edges = offsets[at : to + 1]
            edges = edges[(edges > here) & (edges < stop)] - here
            starts, hashes = _words(data[here:stop], edges)
            starts_of.append(starts + here)
            hashes_of.append(hashes)
            here = stop
        starts = np.concatenate([*starts_of, np.zeros(0, np.int64)]).astype(np.int64)
        hashes = np.concatenate([*hashes_of, np.zeros(0, np.uint64)])
        breaks = np.flatnonzero(data[begin:end] == 10) + begin
        breaks_before = np.searchsorted(breaks, offsets[at : to + 1])  # of each row's start
        row = np.searchsorted(offsets[at + 1 : to + 1], starts, "right")
        line = np.searchsorted(breaks, starts) - breaks_before[row]
        yield Words(hashes, row, line, at, to - at, np.diff(breaks_before) + 1)
        at = to


def unit_starts(unit: np.ndarray) -> np.ndarray:
    """Where each run of equal (ascending) units begins."""
    if not len(unit):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))


def shingles(hashes: np.ndarray, unit: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, unit) of the ``k``-word shingles within each unit; fewer words are one shingle."""
    n = len(hashes)
    starts = unit_starts(unit)
    counts = np.diff(np.concatenate([starts, [n]]))
    left = np.repeat(starts + counts, counts) - np.arange(n)  # words from here to the unit's end
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        more = left > j
        at = np.flatnonzero(more)
        h[at] = mix(h[at] * _M2 + hashes[at + j])
    valid = left >= k
    valid[starts] = True
    return h[valid], unit[valid]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words, whatever text they are in."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _table(_R, len(hashes))[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[: len(total) - n]) * _table(_R_INVERSE, len(hashes))[: len(total) - n])
