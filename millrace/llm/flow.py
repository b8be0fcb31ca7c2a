"""Filling quotas from patterns at least cost.

A transport problem: patterns offer tokens, the first lot free and every further lot at a price higher by
one; a pattern may send tokens to its member sources, each up to a limit; every source takes up to its
quota. Only offers have a price, so the cheapest largest flow is found price by price: with the offers up
to some price made, nothing more can be sent, then those of the next price are added. Sending may reroute:
a source that is full passes on tokens of a pattern to another member of that pattern.

All steps are array operations over the (pattern, source) pairs; what is searched is the graph of
sources, in which one step moves tokens of all patterns at once.
"""

from __future__ import annotations

import numpy as np


def _take(available: np.ndarray, amount: int) -> np.ndarray:
    """``amount`` in all, taken from ``available`` in order."""
    after = np.minimum(np.cumsum(available), amount)
    return np.diff(after, prepend=0)


class Filling:
    """``pattern`` and ``source`` number the ends of every pair, ``room`` limits it; pairs are distinct."""

    def __init__(self, pattern: np.ndarray, source: np.ndarray, room: np.ndarray, patterns: int, quotas: np.ndarray):
        order = np.lexsort((pattern, source))
        self.back = np.empty(len(order), dtype=np.int64)
        self.back[order] = np.arange(len(order))
        self.pattern, self.source = pattern[order].astype(np.int64), source[order].astype(np.int64)
        self.room, self.flow = room[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        self.left = quotas.astype(np.int64).copy()
        self.offered = np.zeros(patterns, dtype=np.int64)
        self.starts = np.searchsorted(self.source, np.arange(len(quotas) + 1))

    def _pairs(self, source: int) -> slice:
        return slice(int(self.starts[source]), int(self.starts[source + 1]))

    def offer(self, patterns: np.ndarray, tokens: np.ndarray) -> bool:
        """Offer tokens of patterns and send as many as can be sent; False if no later offer can be taken either.

        What is not taken is not offered again: it cannot be taken later without a cheaper offer giving way.
        """
        self.offered[:] = 0
        self.offered[patterns] = tokens
        for s in np.flatnonzero(self.left > 0):
            self._send([int(s)])
        while (path := self._path()) is not None:
            self._send(path)
        return bool((self.left > 0).any())

    def _send(self, path: list[int]) -> None:
        """Send what is offered to the first source of the path, each passing on to the next, the last keeping it."""
        first = self._pairs(path[0])
        start = np.minimum(self.offered[self.pattern[first]], self.room[first])
        moves, most = [], min(int(start.sum()), int(self.left[path[-1]]))
        for a, b in zip(path, path[1:]):
            pa, pb = self._pairs(a), self._pairs(b)
            _, ia, ib = np.intersect1d(self.pattern[pa], self.pattern[pb], assume_unique=True, return_indices=True)
            ia, ib = ia + pa.start, ib + pb.start
            can = np.minimum(self.flow[ia], self.room[ib])
            moves.append((ia, ib, can))
            most = min(most, int(can.sum()))
        if not most:
            return
        sent = _take(start, most)
        self.offered[self.pattern[first]] -= sent
        self.flow[first] += sent
        self.room[first] -= sent
        for ia, ib, can in moves:
            moved = _take(can, most)
            self.flow[ia] -= moved
            self.room[ia] += moved
            self.flow[ib] += moved
            self.room[ib] -= moved
        self.left[path[-1]] -= most

    def _path(self) -> list[int] | None:
        """The shortest way for an offer into a source that has something left, over sources that pass on."""
        sources, patterns = len(self.left), len(self.offered)
        onward = np.full(sources, -1, dtype=np.int64)
        reached = self.left > 0
        if not reached.any():
            return None
        #: a reached source each pattern has room to
        into = np.full(patterns, -1, dtype=np.int64)
        fresh = reached.copy()
        while fresh.any():
            open_pairs = np.flatnonzero((self.room > 0) & fresh[self.source] & (into[self.pattern] < 0))
            into[self.pattern[open_pairs]] = self.source[open_pairs]
            ready = open_pairs[self.offered[self.pattern[open_pairs]] > 0]
            if len(ready):
                path = [int(self.source[ready[0]])]
                while self.left[path[-1]] == 0:
                    path.append(int(onward[path[-1]]))
                return path
            passing = np.flatnonzero((self.flow > 0) & ~reached[self.source] & (into[self.pattern] >= 0))
            fresh = np.zeros(sources, dtype=bool)
            fresh[self.source[passing]] = True
            onward[self.source[passing]] = into[self.pattern[passing]]
            reached |= fresh
        return None

    def flows(self) -> np.ndarray:
        """Tokens of every pair, in the order the pairs were given."""
        return self.flow[self.back]


def fill(pattern: np.ndarray, source: np.ndarray, room: np.ndarray, tokens: np.ndarray, first: np.ndarray, lots: np.ndarray, quotas: np.ndarray) -> np.ndarray:
    """Tokens of every pair in the cheapest of the largest flows.

    Pattern p offers ``tokens[p]`` at each of the prices ``first[p]`` to ``first[p] + lots[p] - 1``.
    """
    work = Filling(pattern, source, room, len(tokens), quotas)
    price, last = 0, int((first + lots).max(initial=0))
    while price < last:
        active = np.flatnonzero((first <= price) & (price < first + lots))
        if not len(active):
            price = int(first[first > price].min())
            continue
        if not work.offer(active, tokens[active]):
            break
        price += 1
    return work.flows()
