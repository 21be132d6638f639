"""FM-index over a sequence of integer symbols, with all queries vectorised."""

from __future__ import annotations

import numpy as np

from .textvec import U64


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of a sequence whose last symbol, 0, occurs nowhere else.

    Prefix doubling, started from as many symbols as fit in one word; each round
    sorts only the suffixes that are still tied.
    """
    n, per = len(text), max(1, 62 // bits)
    key = np.zeros(n + per, dtype=U64)
    key[:n] = text
    packed = np.zeros(n, dtype=U64)
    for k in range(per):
        packed = (packed << U64(bits)) | key[k : n + k]
    order = np.argsort(packed, kind="stable")
    run = packed[order]
    slot = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    while True:
        new = np.concatenate(([True], run[1:] != run[:-1]))
        first = slot[np.flatnonzero(new)]
        size = np.diff(np.append(np.flatnonzero(new), len(run)))
        at = order[slot]
        rank[at] = np.repeat(first, size)
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        slot, at = slot[tied], at[tied]
        second = rank[np.minimum(at + per, n - 1)]
        run = (rank[at].astype(U64) << U64(32)) | second.astype(U64)
        by = np.argsort(run, kind="stable")
        order[slot], run = at[by], run[by]
        per *= 2


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // 64 + 1, dtype=U64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        block = i >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(U64)) & U64(1)).astype(bool)


class WaveletTree:
    """Ranks of symbols in a sequence, by a wavelet tree whose levels are laid out as a matrix."""

    def __init__(self, text: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            flags = ((text >> k) & 1).astype(bool)
            self.levels.append(Bits(flags))
            self.zeros.append(int(len(text) - flags.sum()))
            text = np.concatenate((text[~flags], text[flags]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first i positions."""
        low = np.zeros_like(i)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = level.rank(low), level.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        at, symbol = i, np.zeros_like(i)
        low = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros):
            one = level.get(at)
            a, b = level.rank(low), level.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
            symbol = (symbol << 1) | one
        return symbol, at - low


class FMIndex:
    """Counts and locates patterns in a sequence of symbols from 1 up to `symbols`."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        bits = max(1, int(symbols).bit_length())
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text, bits)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], bits)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        marked = order % sample == 0
        self.marked, self.sampled = Bits(marked), order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns of one length, a row each: first row of the suffix array that starts with it, and last (exclusive)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.less[c] + self.tree.rank(c, low[alive])
            high[alive] = self.less[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the text of the suffixes at these rows: walk back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            here = self.marked.get(at)
            out[todo[here]] = self.sampled[self.marked.rank(at[here])] + steps
            todo, at = todo[~here], at[~here]
            if len(todo):
                symbol, before = self.tree.access(at)
                at = self.less[symbol] + before
            steps += 1
        return out
