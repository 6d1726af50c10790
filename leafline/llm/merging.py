"""Rank-synchronous pair merging over ragged arrays.

A batch of sequences lies in one array of symbol numbers. In each step every
unfinished sequence joins its pair of lowest rank, all at once; finished
sequences leave the arrays. Equal pairs of one sequence are joined together as
long as that cannot differ from joining them one after the other, else only the
leftmost one is.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 40


class PairTable:
    """(left, right) -> (rank, symbol), by open addressing. Symbols are below 2**20."""

    def __init__(self, left, right, rank, symbol):
        key = (np.asarray(left, np.int64) << 20) | np.asarray(right, np.int64)
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(key)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int64)
        self.symbols = np.full(size, -1, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[todo[free]]
            won = self.keys[slot] == key[todo]
            self.ranks[slot[won]] = np.asarray(rank, np.int64)[todo[won]]
            self.symbols[slot[won]] = np.asarray(symbol, np.int32)[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Slots of the pairs; a slot without the pair has the rank NONE."""
        key = (left.astype(np.int64) << 20) | right
        slot = self._slot(key)
        there = self.keys[slot]
        more = np.flatnonzero((there != key) & (there != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[more]]
            more = more[(there != key[more]) & (there != -1)]
        return slot

    def rank(self, left, right):
        return self.ranks[self.find(left, right)]


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left of each sequence, joined in order, and how many each has."""
    lengths = np.asarray(lengths, np.int64)
    counts = np.zeros(len(lengths), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    which = np.flatnonzero(lengths > 0)
    ids, size = np.asarray(symbols, np.int64), lengths[which]
    rank = np.full(len(ids), NONE, np.int64)
    if len(ids) > 1:
        rank[:-1] = table.rank(ids[:-1], ids[1:])
    rank[np.cumsum(size) - 1] = NONE
    while len(which):
        starts = np.cumsum(size) - size
        low = np.minimum.reduceat(rank, starts)
        over = low == NONE
        if over.any():
            gone = np.repeat(over, size)
            done.append((which[over], size[over], ids[gone]))
            counts[which[over]] = size[over]
            ids, rank, which, size, low = ids[~gone], rank[~gone], which[~over], size[~over], low[~over]
            if not len(which):
                break
            starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(which)), size)
        hit = np.flatnonzero(rank == low[owner])
        # of overlapping pairs every second one, from the left
        new_run = np.ones(len(hit), bool)
        new_run[1:] = np.diff(hit) > 1
        run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run_at) % 2 == 0]
        hit = _safe(hit, owner, ids, starts, size, low, table)
        made = table.symbols[table.find(ids[hit], ids[hit + 1])]
        ids[hit] = made
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        place = np.cumsum(keep) - 1
        size = size - np.bincount(owner[hit], minlength=len(which))
        at = place[hit]
        ids, rank = ids[keep], rank[keep]
        ends = np.cumsum(size) - 1
        last = np.zeros(len(ids), bool)
        last[ends] = True
        rank[at] = NONE
        right = at[~last[at]]
        rank[right] = table.rank(ids[right], ids[right + 1])
        left = at[at > 0] - 1
        left = left[~last[left]]
        rank[left] = table.rank(ids[left], ids[left + 1])
    out = np.zeros(int(counts.sum()), np.int64)
    to = np.cumsum(counts) - counts
    for own, n, values in done:
        out[np.repeat(to[own] - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
    return out, counts


def _safe(hit, owner, ids, starts, size, low, table):
    """hit, less those that a join before them in the same sequence may forestall."""
    several = np.bincount(owner[hit], minlength=len(size))[owner[hit]] > 1
    if not several.any():
        return hit
    first = np.ones(len(hit), bool)
    first[1:] = owner[hit][1:] != owner[hit][:-1]
    some = hit[several]
    own, new = owner[some], table.symbols[table.find(ids[some], ids[some + 1])].astype(np.int64)
    bound, bad = low[own], np.zeros(len(some), bool)
    follows = some + 2 < starts[own] + size[own]
    at = some[follows]
    after = ids[at + 2]
    bad[follows] |= table.rank(new[follows], after) <= bound[follows]
    leads = some > starts[own]
    before = ids[some[leads] - 1]
    bad[leads] |= table.rank(before, new[leads]) <= bound[leads]
    touching = np.zeros(len(some), bool)
    touching[1:] = (np.diff(some) == 2) & (own[1:] == own[:-1])
    bad[touching] |= table.rank(new[np.flatnonzero(touching) - 1], new[touching]) <= bound[touching]
    unsafe = np.zeros(len(size), bool)
    unsafe[own[bad]] = True
    return hit[first | ~unsafe[owner[hit]]]
