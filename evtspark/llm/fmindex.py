"""A compressed full-text index over word numbers: Burrows-Wheeler text in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with a count before each 64-bit block."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(self.n // 64 + 1, np.uint64)
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.blocks) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.blocks), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & low)


class FMIndex:
    """Index of ``text`` for patterns of up to 32 symbols over 1, 2, ...; it ends with 0, which parts texts and is in no pattern.

    Suffixes are sorted by their first 32 symbols, which is all that backward
    search of such patterns needs.
    """

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        self.text, self.sigma = text, int(text.max(initial=0)) + 1
        rank, depth = text.astype(np.int64), 1
        while depth < 32:
            after = np.full(n, -1, np.int64)
            after[:-depth] = rank[depth:]
            rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1]
            depth *= 2
            if rank.max(initial=0) == n - 1:
                break
        self.suffix = np.argsort(rank, kind="stable")
        bwt = text[self.suffix - 1].astype(np.int64)
        self.first = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.first[1:])
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones)))
            self.zeros.append(n - int(ones.sum()))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.last = self._starts()

    def _starts(self) -> np.ndarray:
        """Where each symbol's run begins after the last level."""
        at = np.zeros(self.sigma, np.int64)
        symbols = np.arange(self.sigma)
        for (bit, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.ones(at)
            at = np.where((symbols >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transformed text before each position."""
        for (bit, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.ones(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at - self.last[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns with one more symbol in front."""
        first = self.first[symbol]
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return first + both[: len(symbol)], first + both[len(symbol) :]

    def statistics(self, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) for each ``text[start : start + limit]``: the matching statistic of its end, and that match's suffix interval.

        The statistic is the largest number of last symbols, up to ``limit``, that
        occur at least twice in the text. Backward search takes one symbol a step
        from the end; a row leaves when one more symbol would make it unique.
        """
        length, rows = np.zeros(len(starts), np.int64), np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.text), np.int64)
        for k in range(limit - 1, -1, -1):
            low_, high_ = self.extend(self.text[starts[rows] + k], low[rows], high[rows])
            more = high_ - low_ > 1
            rows = rows[more]
            low[rows], high[rows] = low_[more], high_[more]
            length[rows] += 1
        return length, low, high

    def least(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest ``value[position]`` over the occurrences in each interval."""
        if not len(low):
            return np.empty(0, value.dtype)
        pairs, back = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
        of = np.append(value[self.suffix], 0)
        return np.minimum.reduceat(of, pairs.T.ravel())[::2][back.ravel()]
