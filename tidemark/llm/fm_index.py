"""FM-index over integer symbols: suffix array, wavelet matrix with rank directory, sampled suffix positions.

Symbol 0 separates runs. Every separator counts as a symbol of its own (ordered by position), so no suffix order
depends on what lies beyond a run, and no search or walk crosses one.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling that sorts again only the suffixes still tied. ``symbols`` must end with a separator."""
    n = len(symbols)
    seps = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(seps)
    rank[seps] = np.arange(len(seps))
    sa = np.argsort(rank, kind="stable")
    ordered = rank[sa]
    start = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    width, tied = 1, np.arange(n)
    while True:
        # a slot is settled once its group has one member: it starts a group and so does its successor
        tied = tied[~(start[tied] & np.append(start, True)[tied + 1])]
        if not len(tied):
            return sa
        at = sa[tied]
        first, second = rank[at], rank[at + width]
        order = np.argsort(first * n + second, kind="stable")
        at, first, second = at[order], first[order], second[order]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        sa[tied] = at
        start[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        width *= 2


class BitRank:
    """Bits packed in 64-bit words with a directory of counts before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]
        self.ones = int(np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = 8):
        """``symbols``: at least one, the last a separator."""
        n = self.n = len(symbols)
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        self.bits = max(1, int(symbols.max()).bit_length())
        self.levels: list[BitRank] = []
        self.zeros: list[int] = []
        row = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            self.levels.append(BitRank(bit))
            self.zeros.append(n - self.levels[-1].ones)
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        counts = np.bincount(symbols, minlength=(1 << self.bits))
        before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        alphabet = np.arange(1 << self.bits)
        self.base = before - self._descend(alphabet, np.zeros(1 << self.bits, dtype=np.int64))
        # sampled positions: every ``sample``-th, and each first of a run, where a backward walk must end
        inside = np.arange(n)
        first = np.concatenate(([True], symbols[:-1] == 0))
        chosen = ((inside % sample == 0) | first | (symbols == 0))[sa]
        self.marked = BitRank(chosen)
        self.positions = sa[chosen]

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where((c >> (self.bits - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First row of those that start with c followed by what row i starts with."""
        return self.base[c] + self._descend(c, i)

    def _access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol before each row, and the row that starts with it."""
        c = np.zeros(len(i), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            bit, ones = bits.get(i), bits.rank(i)
            c = (c << 1) | bit
            i = np.where(bit, zeros + ones, i - ones)
        return c, self.base[c] + i

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases by backward search. ``phrases``: one a row, right-aligned."""
        total, width = phrases.shape
        low, high = np.zeros(total, dtype=np.int64), np.full(total, self.n, dtype=np.int64)
        known = phrases < (1 << self.bits)
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            c = phrases[live, width - 1 - k]
            ok = known[live, width - 1 - k]
            high[live[~ok]] = low[live[~ok]]
            live, c = live[ok], c[ok]
            low[live], high[live] = self.step(c, low[live]), self.step(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one and add the steps."""
        out, todo, at, steps = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.marked.get(at)
            out[todo[hit]] = self.positions[self.marked.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(at):
                at = self._access(at)[1]
            steps += 1
        return out
