"""An FM-index over integer symbols, with numpy.

The text is a sequence of symbols 0..sigma-1 in which 0 is a separator: every separator is smaller than
any other symbol and separators differ by their place, so no match and no suffix comparison goes past
one. Ranks over the Burrows-Wheeler transform come from a wavelet matrix whose levels are bit vectors
with counted words; suffix positions are kept for every ``sample``-th text position and for positions
right after a separator, so that walking back from any row meets a kept position within ``sample`` steps.
All operations take arrays, so that many patterns are searched at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling over the suffixes that are still tied."""
    n = len(text)
    separators = text == 0
    n_sep = int(separators.sum())
    # the rank of a suffix is the place of the last one of those not told apart from it, so far
    key = text.astype(np.int64) + n_sep - 1
    key[separators] = np.arange(n_sep)
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    _set_ranks(rank, order, key[order], 0)
    tied = _ties(rank[order])
    width = 1
    while len(tied):
        suffix = order[tied]
        following = suffix + width
        # tied suffixes hold no separator in their first ``width`` symbols, hence end before the text does
        second = rank[np.minimum(following, n - 1)]
        combined = rank[suffix] * (n + 1) + second
        by = np.argsort(combined)
        order[tied] = suffix[by]
        combined = combined[by]
        # ranks inside one old group move down from its last place
        last = np.append(np.flatnonzero(combined[1:] != combined[:-1]), len(combined) - 1)
        sizes = np.diff(np.append(-1, last))
        rank[order[tied]] = np.repeat(tied[last], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


def _set_ranks(rank: np.ndarray, order: np.ndarray, keys: np.ndarray, base: int) -> None:
    last = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1)
    rank[order] = np.repeat(last + base, np.diff(np.append(-1, last)))


def _ties(ranks: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    return np.flatnonzero(np.append(same, False) | np.append(False, same))


class _Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.append(bits, np.zeros(-n % 64 + 64, dtype=bool)), bitorder="little")
        self.words = packed.view(np.uint64)
        self.counts = np.append(0, np.cumsum(np.bitwise_count(self.words)))[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over a sequence of symbols, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[_Bits] = []
        self.zeros: list[int] = []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            self.levels.append(_Bits(bits))
            self.zeros.append(len(symbols) - int(bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``i`` symbols, relative to its start: subtract rank(symbol, 0)."""
        i = i.astype(np.int64)
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at ``i``, and where they stand after the last level."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            bit = bits.get(i).astype(np.int64)
            ones = bits.rank(i)
            i = np.where(bit == 1, zeros + ones, i - ones)
            symbol = symbol * 2 + bit
        return symbol, i


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        """``text`` starts with a separator; symbols are below ``sigma``."""
        order = suffix_order(text)
        transform = text[order - 1]
        self.n = len(text)
        self.wavelet = WaveletMatrix(transform, sigma)
        counts = np.bincount(text, minlength=sigma)
        self.before = np.append(0, np.cumsum(counts))[:-1]
        every = np.arange(sigma)
        #: place of each symbol's first occurrence on the last level
        self.base = self.wavelet.rank(every, np.zeros(sigma, dtype=np.int64))
        kept = (order % sample == 0) | (transform == 0)
        self.kept = _Bits(kept)
        self.samples = order[kept].astype(np.int32 if self.n < 2**31 else np.int64)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of those rows of ``patterns`` (of equal length) that occur, with their row intervals."""
        alive = np.arange(len(patterns))
        last = patterns[:, -1]
        low = self.before[last]
        high = np.append(self.before, self.n)[last + 1]
        for step in range(patterns.shape[1] - 2, -1, -1):
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
            symbol = patterns[alive, step]
            shift = self.before[symbol] - self.base[symbol]
            low = shift + self.wavelet.rank(symbol, low)
            high = shift + self.wavelet.rank(symbol, high)
        some = low < high
        return alive[some], low[some], high[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by row."""
        out = np.empty(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        rows = rows.astype(np.int64)
        steps = 0
        while len(todo):
            kept = self.kept.get(rows) == 1
            out[todo[kept]] = self.samples[self.kept.rank(rows[kept])] + steps
            todo, rows = todo[~kept], rows[~kept]
            if len(todo):
                symbol, place = self.wavelet.access(rows)
                rows = self.before[symbol] - self.base[symbol] + place
            steps += 1
        return out
