"""Words of many texts as 64-bit numbers, with numpy.

Words are the longest runs of ASCII letters and digits, letter case ignored. A word's number is a
polynomial of its characters modulo 2^64, mixed. Two different words have the same number with a chance
of about 2^-64, which is taken as never.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: bytes worked on at a time
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.zeros(256, dtype=np.uint8)
for _range in (b"abcdefghijklmnopqrstuvwxyz", b"0123456789"):
    _FOLD[list(_range)] = list(_range)
_FOLD[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n - 1, and their inverses modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (none of them null), and where each begins; one more bound at the end."""
    wide = texts.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``_PIECE`` bytes that end after a byte no word holds, or where the text does."""
    at = 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        step = 1 << 12
        while end < len(raw) and _FOLD[raw[end - 1]]:
            gap = np.flatnonzero(_FOLD[raw[end : end + step]] == 0)
            end = end + int(gap[0]) + 1 if len(gap) else min(end + step, len(raw))
            step *= 2
        yield at, end
        at = end


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts with these bounds, and the number of the first word of each text; one more at the end.

    A word never reaches over the end of a text.
    """
    hashes, starts_at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    cuts = bounds[1:-1]
    for at, end in _pieces(raw):
        folded = _FOLD[raw[at:end]]
        inside = folded > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        own = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, end)] - at
        # a text that ends inside a run of letters ends the word
        own = own[inside[own] & inside[own - 1]]
        begins[own] = True
        ends[own - 1] = True
        begin, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _powers(max(_PIECE, len(folded)))
        sums = np.zeros(len(folded) + 1, dtype=np.uint64)
        np.cumsum(folded * power[: len(folded)], out=sums[1:])
        value = (sums[stop] - sums[begin]) * inverse[begin]
        hashes.append(mix(value + (stop - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        starts_at.append(begin + at)
    places = np.concatenate(starts_at)
    return np.concatenate(hashes), np.searchsorted(places, bounds)
