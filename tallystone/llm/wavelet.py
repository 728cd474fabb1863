"""A compressed full-text index over integer symbols: wavelet matrix, backward search, bounded contexts."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A bit vector packed in 64-bit words with a count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits, for many i."""
        w = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i; start: where the symbol's run begins at the last level."""
        for k, (b, z) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = b.rank1(i)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, z + one, i - one)
        return i - start

    def starts(self, n_symbols: int) -> np.ndarray:
        """For each symbol, where its run begins at the last level (the rank path of position 0)."""
        symbol, i = np.arange(n_symbols), np.zeros(n_symbols, np.int64)
        return self.rank(symbol, i, np.zeros(n_symbols, np.int64))


class ContextIndex:
    """FM-index of a symbol sequence (0 ends a segment) for patterns of up to `depth` symbols.

    Suffixes are sorted by their first `depth` symbols only, which leaves backward search
    right for patterns of that length: the rows of a shorter pattern are adjacent in
    either order.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        self.n_symbols = int(text.max(initial=0)) + 1
        before = self._ranks(text, depth - 1)
        full = self._joined(before, np.concatenate([text[depth - 1 :], np.zeros(min(n, depth - 1), text.dtype)]))
        order = np.argsort(full, kind="stable")
        self.sa = order
        self.wm = WaveletMatrix(text[order - 1], self.n_symbols)
        counts = np.bincount(text, minlength=self.n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.start = self.wm.starts(self.n_symbols)
        # Of each row: the rows that share depth - 1 symbols (the parent), and the least text position of its full context.
        self.parent_lo, self.parent_hi, _ = self._groups(before[order])
        lo, _, group = self._groups(full[order])
        self.earliest = np.minimum.reduceat(order, lo[np.concatenate([[True], group[1:] != group[:-1]])])[group] if n else order

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    def _ranks(self, text: np.ndarray, depth: int) -> np.ndarray:
        """The rank of each suffix by its first `depth` symbols, by doubling."""
        r, have = text.astype(np.int64), 1
        while have < depth:
            step = min(have, depth - have)
            shifted = np.concatenate([r[step:], np.zeros(min(len(r), step), np.int64)])
            r, have = self._joined(r, shifted), have + step
        return r

    @staticmethod
    def _groups(sorted_ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the first row and the row after the last of those with its rank; the group's number."""
        if not len(sorted_ranks):
            return sorted_ranks, sorted_ranks, sorted_ranks
        new = np.concatenate([[True], sorted_ranks[1:] != sorted_ranks[:-1]])
        group = np.cumsum(new) - 1
        lo = np.flatnonzero(new)
        return lo[group], np.append(lo[1:], len(sorted_ranks))[group], group

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of symbol + pattern, from the rows [lo, hi) of each pattern."""
        base, start = self.first[symbol], self.start[symbol]
        return base + self.wm.rank(symbol, lo, start), base + self.wm.rank(symbol, hi, start)

    def earliest_matches(self, text: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams segments through the index, from right to left, all in step.

        ends: where each segment's last symbol lies; runs: its number of full windows.
        Gives the start of each window and the least start of an equal window. The match
        grows to `depth` symbols; then, for the next window, its last symbol is given up
        (the parent) and the one before is added.
        """
        n = len(self.sa)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), n, np.int64)
        at = ends.astype(np.int64)
        for _ in range(self.depth):
            lo, hi = self.extend(text[at], lo, hi)
            at = at - 1
        starts, found = [at + 1], [self.earliest[lo]]
        left, k = np.flatnonzero(runs > 1), 1
        while len(left):
            row = lo[left]
            lo[left], hi[left] = self.extend(text[at[left]], self.parent_lo[row], self.parent_hi[row])
            starts.append(at[left])
            found.append(self.earliest[lo[left]])
            at[left] -= 1
            k += 1
            left = left[runs[left] > k]
        return np.concatenate(starts), np.concatenate(found)
