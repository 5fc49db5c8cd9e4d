"""A compressed FM-index over integer sequences, for batches of patterns of bounded length."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector in 64-bit words with a running count per word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Symbols' bits level by level from the highest, each level stably parted by the one above (a wavelet tree laid out as a matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros, now = [], [], symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1 == 1
            self.levels.append(_Bits(bit))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.origin = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbols >> (len(self.levels) - 1 - i)) & 1 == 1
            ones = level.ones(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, at) - self.origin[symbols]


class FMIndex:
    """The index of a sequence of symbols (0 parts texts, and no pattern holds it) for patterns of up to ``depth`` symbols.

    Suffixes are sorted by their first ``depth`` symbols, which is all that backward steps on shorter patterns tell apart.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        ranks = {1: symbols.astype(np.int64)}
        length, order = 1, None

        def combined(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
            after = np.zeros(n, np.int64)
            after[: max(0, n - shift)] = b[shift:] + 1
            key = a * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            return rank, order

        while 2 * length <= depth:
            ranks[2 * length], order = combined(ranks[length], ranks[length], length)
            length *= 2
        rank, done = ranks[length], length
        for part in sorted((k for k in ranks if k < length), reverse=True):
            if done + part <= depth:
                rank, order = combined(rank, ranks[part], done)
                done += part
        if order is None:
            order = np.argsort(rank, kind="stable")
        self.suffixes = order
        self.tree = WaveletTree(symbols[order - 1], max(1, int(symbols.max(initial=0)).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.tree.origin)))]).astype(np.int64)

    def repeated(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the indexed windows symbols[start:start+length], those that occur at least twice, and their rows' intervals in suffix order.

        All windows take their backward steps together; one whose interval has shrunk to its own row is dropped.
        """
        alive = np.arange(len(starts))
        last = symbols[starts + length - 1]
        low, high = self.smaller[last], self.smaller[last + 1]
        for back in range(length - 2, -1, -1):
            keep = high - low > 1
            if not keep.all():
                alive, low, high = alive[keep], low[keep], high[keep]
            if not len(alive):
                break
            symbol = symbols[starts[alive] + back]
            base = self.smaller[symbol]
            low, high = base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)
        keep = high - low > 1
        return alive[keep], low[keep], high[keep]
