"""Multi-index hashing of 64-bit codes: segments are looked up near their own values, matches verified whole."""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

BITS = 64
#: Bits of a segment, about as many as number the codes.
LEAST_BITS, MOST_BITS = 4, 16
#: Codes that are asked for at a time.
BATCH = 256


@functools.lru_cache(maxsize=128)
def flips(bits: int, r: int) -> np.ndarray:
    """All masks of exactly r of the bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)] or [0], np.int64)


@functools.lru_cache(maxsize=32)
def ball(bits: int, r: int) -> np.ndarray:
    """All masks of at most r of the bits."""
    return np.concatenate([flips(bits, x) for x in range(min(r, bits) + 1)])


class MultiIndex:
    """Codes in m tables, one for each segment: a table lists the codes by the segment's value.

    compared counts the codes whose whole distance was taken.
    """

    def __init__(self, codes: np.ndarray, m: int | None = None) -> None:
        self.codes = codes.astype(np.uint64)
        wanted = min(max(len(codes).bit_length(), LEAST_BITS), MOST_BITS)
        self.m = m or -(-BITS // wanted)
        cuts = [BITS * s // self.m for s in range(self.m + 1)]
        self.low, self.bits = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        self.compared = 0
        self.tables = []
        for s in range(self.m):
            value = self.segment(self.codes, s)
            start = np.zeros((1 << self.bits[s]) + 1, np.int32)
            np.cumsum(np.bincount(value, minlength=1 << self.bits[s]), out=start[1:])
            self.tables.append((np.argsort(value, kind="stable").astype(np.int32), start))

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(self.low[s])) & np.uint64((1 << self.bits[s]) - 1)).astype(np.int64)

    def _listed(self, s: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of values, place) of every code whose segment s has one of the values: values is a table, a row for each code asked for."""
        order, start = self.tables[s]
        begin, size = start[values], start[values + 1] - start[values]
        row, column = np.nonzero(size)
        n = size[row, column].astype(np.int64)
        end = np.cumsum(n)
        at = np.repeat(begin[row, column] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)
        return np.repeat(row, n), order[at].astype(np.int64)

    def distance(self, code: np.ndarray | int, at: np.ndarray) -> np.ndarray:
        self.compared += len(at)
        return np.bitwise_count(self.codes[at] ^ np.asarray(code, np.uint64)).astype(np.int64)

    def within(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the given codes, place, distance) of all codes at most radius away from them.

        Segment s is looked up as far as reach[s], and these and one more for each segment add up to radius + 1: a code that is
        farther away in every segment is over radius away in all, so the segments' balls list every code wanted.
        """
        reach = [(radius + 1) // self.m - 1 + (s < (radius + 1) % self.m) for s in range(self.m)]
        found = [(np.empty(0, np.int64),) * 3]
        for lo in range(0, len(codes), BATCH):
            part = codes[lo : lo + BATCH].astype(np.uint64)
            listed = [self._listed(s, self.segment(part, s)[:, None] ^ ball(self.bits[s], r)[None, :]) for s, r in enumerate(reach) if r >= 0]
            which, at = divmod(np.unique(np.concatenate([row * len(self.codes) + place for row, place in listed])), max(len(self.codes), 1))
            d = self.distance(part[which], at)
            near = d <= radius
            found.append((which[near] + lo, at[near], d[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def nearest(self, code: int, k: int, bound: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the k nearest codes among those at most bound away, ties at the k-th included, nearest first.

        After the rings up to r of all segments, every code at most m * (r + 1) - 1 away has been seen;
        segments grow one at a time, each adding one to that, until it covers the k-th verified distance or the bound.
        """
        n = len(self.codes)
        seen, counted, covered = np.zeros(n, bool), np.zeros(BITS + 1, np.int64), -1
        places, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        own = np.array([code], np.uint64)
        for r in range(max(self.bits) + 1):
            for s in range(self.m):
                if r <= self.bits[s]:
                    _, new = self._listed(s, self.segment(own, s)[:, None] ^ flips(self.bits[s], r)[None, :])
                    new = new[~seen[new]]
                    if len(new):
                        seen[new] = True
                        d = self.distance(code, new)
                        counted += np.bincount(d, minlength=BITS + 1)
                        places.append(new)
                        distances.append(d)
                covered = self.m * r + s
                if covered >= bound or counted[: covered + 1].sum() >= k:
                    return self._cut(np.concatenate(places), np.concatenate(distances), k, bound)
        return self._cut(np.concatenate(places), np.concatenate(distances), k, bound)

    @staticmethod
    def _cut(at: np.ndarray, distance: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        near = distance <= bound
        at, distance = at[near], distance[near]
        if not k:
            return at[:0], distance[:0]
        if len(at) > k:
            keep = distance <= np.partition(distance, k - 1)[k - 1]
            at, distance = at[keep], distance[keep]
        order = np.argsort(distance, kind="stable")
        return at[order], distance[order]
