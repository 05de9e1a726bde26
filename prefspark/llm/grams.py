"""Character windows of whole texts, hashed with numpy; shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHUNK_CHARS = 300_000  # code points handled at once; a longer text is handled in overlapping slices
SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def fold(text: str) -> np.ndarray:
    """Lower-case code points of ``text`` with every non-letter as a space."""
    return _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def chunks(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(codes, starts, rows, counted): texts laid one after another, each as space + letters + space.

    ``rows[j]`` is the text that begins at ``starts[j]``. A text over CHUNK_CHARS comes as
    several slices that go on ``overlap`` code points beyond the windows that they count: only
    windows that begin before ``counted`` belong to a chunk. Null is the empty text.
    """
    held: list[str] = []
    rows: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        text = f" {text or ''} "
        if held and size + len(text) > CHUNK_CHARS:
            yield *_laid(held, rows), size
            held, rows, size = [], [], 0
        if len(text) > CHUNK_CHARS:
            for at in range(0, len(text), CHUNK_CHARS):
                yield *_laid([text[at : at + CHUNK_CHARS + overlap]], [row]), CHUNK_CHARS
            continue
        held.append(text)
        rows.append(row)
        size += len(text)
    if held:
        yield *_laid(held, rows), size


def _laid(parts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return fold("".join(parts)), np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.array(rows)


def windows(codes: np.ndarray, starts: np.ndarray, counted: int, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (``bits`` bits) of the ``n`` code points from each place on, and whether they count.

    A window counts if it lies in one text and has no space but, at most, its first code point
    (so it tells the start of a word), and if it begins before ``counted``.
    """
    size = len(codes)
    buckets = np.zeros(size, np.uint32)
    valid = np.zeros(size, bool)
    if size < n:
        return buckets, valid
    m = size - n + 1
    h = np.full(m, (n * int(_STEP)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    ok = np.ones(m, bool)
    for k in range(n):
        c = codes[k : k + m]
        h += c
        h *= _MIX
        h ^= h >> np.uint64(29)
        if k or n == 1:
            ok &= c != SPACE
    edge = np.zeros(size + 1, bool)
    edge[starts] = True
    for k in range(1, n):  # a text begins inside the window
        ok &= ~edge[k : k + m]
    buckets[:m] = ((h * _STEP) >> np.uint64(64 - bits)).astype(np.uint32)
    valid[:m] = ok
    valid[counted:] = False
    return buckets, valid
