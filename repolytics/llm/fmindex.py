"""A word-level FM-index over one shard of text, in numpy.

The sequence holds symbols of a fixed alphabet; symbol 0 is a terminator, and any
two terminators differ in the suffix order (by position).  Backward search goes
through a wavelet matrix, many patterns at a time; occurrences are located by
sampled suffix positions.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(seq: np.ndarray) -> np.ndarray:
    """Rank of the suffix at each position; the last symbol is a terminator.

    Prefix doubling that sorts only those suffixes again that still tie.
    """
    n = len(seq)
    ends = seq == 0
    first = np.where(ends, np.cumsum(ends) - 1, seq + int(ends.sum())).astype(np.int64)
    order = np.argsort(first, kind="stable")
    key = first[order]
    rank = np.empty(n, np.int64)

    def heads(k: np.ndarray) -> np.ndarray:
        at = np.arange(len(k))
        return np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], at, 0))

    def tied(run: np.ndarray) -> np.ndarray:
        same = run[1:] == run[:-1]
        return np.r_[same, False] | np.r_[False, same]

    run = heads(key)
    rank[order] = run
    active = order[tied(run)]
    step = 1
    while len(active):
        key = rank[active] * n + rank[active + step]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        base = rank[active]
        run = heads(key)
        rank[active] = base + run - heads(base)
        active = active[tied(run)]
        step *= 2
    return rank


class FMIndex:
    """Backward search and location over one sequence of symbols below ``sigma``."""

    def __init__(self, seq: np.ndarray, sigma: int, rate: int = 16) -> None:
        n = len(seq)
        rank = suffix_ranks(seq)
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = seq[sa - 1]
        self.n, self.bwt = n, bwt
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))][:sigma]
        # A walk back can't pass a terminator, so what follows one is sampled as well.
        self.sampled = (sa % rate == 0) | (bwt == 0)
        self.kept = sa[self.sampled]
        self.slot = np.cumsum(self.sampled) - 1
        self.levels: list[tuple[int, int, np.ndarray]] = []
        row = bwt
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            one = (row >> bit) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((bit, n - int(ones[-1]), ones))
            up = one.astype(bool)
            row = np.concatenate([row[~up], row[up]])
        starts = np.zeros(sigma, np.int64)
        held = np.bincount(row, minlength=sigma)
        seen = row[np.r_[True, row[1:] != row[:-1]]]
        starts[seen] = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        self.starts, self.held = starts, held

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first ``upto`` places of the BWT."""
        at = upto.astype(np.int64)
        for bit, zeros, ones in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            k = ones[at]
            at = np.where(up, zeros + k, at - k)
        return at - self.starts[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of ``patterns`` (all of one length)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero((self.held[patterns] > 0).all(axis=1))
        dead = np.ones(len(patterns), bool)
        dead[alive] = False
        for j in reversed(range(patterns.shape[1])):
            if not len(alive):
                break
            c = patterns[alive, j]
            lo[alive] = self.before[c] + self.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.rank(c, hi[alive])
            gone = lo[alive] >= hi[alive]
            dead[alive[gone]] = True
            alive = alive[~gone]
        hi[dead] = lo[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.kept[self.slot[at[hit]]] + walked
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                c = self.bwt[at]
                at = self.before[c] + self.rank(c, at)
                walked += 1
        return out
