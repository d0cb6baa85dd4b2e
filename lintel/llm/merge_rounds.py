"""Byte-pair merges of many units at once, in rounds over flat arrays.

A round takes in every part the pair of neighbours with the best rank, merges its occurrences from
the left, compacts the arrays, and goes on until no pair is left. One merge at a time by rank, from
the left, is the rule that this must equal: all occurrences of a pair merge at once if no pair that
the merged symbol can form ranks as high; otherwise only the leftmost merges in that round.
"""

from __future__ import annotations

import numpy as np

NO_RANK = np.int32(2**31 - 1)


class PairTable:
    """Ranks and results of mergeable pairs of symbols."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray):
        self.base = int(max(left.max(initial=0), right.max(initial=0), merged.max(initial=0))) + 2
        key = left.astype(np.int64) * self.base + right
        order = np.argsort(key, kind="stable")
        self.key = np.append(key[order], np.int64(2**62))
        self.rank = np.append(rank[order].astype(np.int32), NO_RANK)
        self.merged = np.append(merged[order].astype(np.int64), 0)
        reach = np.full(self.base, NO_RANK, np.int32)  # best rank of a pair that holds a symbol
        np.minimum.at(reach, left, rank.astype(np.int32))
        np.minimum.at(reach, right, rank.astype(np.int32))
        self.alone = reach[self.merged] <= self.rank
        self.none = len(self.key) - 1

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; ``none`` for pairs that do not merge. Negative symbols never do."""
        key = left * self.base + right
        at = np.searchsorted(self.key, key)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), at, self.none)

    def merge(self, symbols: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols, and the place of the first symbol of each; joined says which neighbours may merge."""
        part = np.concatenate([[0], np.cumsum(~joined)])
        position = np.arange(len(symbols))
        slot = np.full(len(symbols), self.none)
        inside = np.flatnonzero(joined)
        slot[inside] = self.slots(symbols[inside], symbols[inside + 1])
        done_at, done_symbol = [], []
        while len(symbols):
            rank = self.rank[slot]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(part))))
            go = best != NO_RANK
            if not go.all():
                done_at.append(position[~go])
                done_symbol.append(symbols[~go])
                symbols, part, position, slot, rank, best = symbols[go], part[go], position[go], slot[go], rank[go], best[go]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            first = np.concatenate([[True], part[at][1:] != part[at][:-1]])
            follows = np.concatenate([[False], at[1:] == at[:-1] + 1]) & ~first
            run_start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            even = (np.arange(len(at)) - run_start) % 2 == 0
            at = at[np.where(self.alone[slot[at]], first, even)]
            symbols[at] = self.merged[slot[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            changed = (np.cumsum(keep) - 1)[at]
            symbols, part, position, slot = symbols[keep], part[keep], position[keep], slot[keep]
            changed = np.concatenate([changed, changed[changed > 0] - 1])
            slot[changed] = self.none
            paired = changed[changed < len(symbols) - 1]
            paired = paired[part[paired] == part[paired + 1]]
            slot[paired] = self.slots(symbols[paired], symbols[paired + 1])
        position, symbols = np.concatenate(done_at), np.concatenate(done_symbol)
        order = np.argsort(position)
        return symbols[order], position[order]
