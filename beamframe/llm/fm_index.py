"""An FM-index over a shard of symbol sequences, in vectorised numpy.

Symbol 0 separates: no pattern holds it, and each 0 counts as a sentinel of its
own, so suffixes compare up to their first 0 and the order is total. Symbols are
ranked by a wavelet matrix over the Burrows-Wheeler transform; text positions are
sampled at every ``step``-th place and behind every separator, so that a walk by
last-to-first steps meets a sample before it meets a separator.
"""

from __future__ import annotations

import numpy as np


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``x``; zeros are distinct sentinels, smaller by position and than all symbols."""
    n = len(x)
    zero = x == 0
    z = int(zero.sum())
    r = np.where(zero, np.cumsum(zero), x.astype(np.int64) + z)
    bits = max(1, int(r.max()).bit_length()) if n else 1
    per = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(per):
        key <<= bits
        key[: n - i] |= r[i:] if i < n else 0
    sa = np.argsort(key)
    k = key[sa]
    new = np.empty(n, bool)
    if n:
        new[0] = True
        new[1:] = k[1:] != k[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    done = per
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)  # places in the order that are not settled; groups are contiguous
        if not len(at):
            return sa
        s = sa[at]
        later = s + done
        tail = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        group = rank[s]
        order = np.lexsort((tail, group))
        s, tail, group = s[order], tail[order], group[order]
        sa[at] = s
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        fresh[1:] = (group[1:] != group[:-1]) | (tail[1:] != tail[:-1])
        new[at] = fresh
        rank[s] = np.maximum.accumulate(np.where(fresh, at, 0))
        done *= 2


class BitVector:
    """Bits with ranks: one count for each 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        inside = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(inside)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, x: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (x >> shift) & 1 == 1
            self.levels.append((shift, BitVector(bit), int(len(bit) - bit.sum())))
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol ``c`` occurs among the first ``i``."""
        low = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (c >> shift) & 1 == 1
            a, b = bits.rank(i), bits.rank(low)
            i = np.where(one, zeros + a, i - a)
            low = np.where(one, zeros + b, low - b)
        return i - low

    def get(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(i)
            r = bits.rank(i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + r, i - r)
        return c


class FMIndex:
    def __init__(self, x: np.ndarray, symbols: int, step: int = 16) -> None:
        x = np.append(x, 0)  # the last symbol has a suffix behind it, too
        sa = suffix_array(x)
        bwt = x[sa - 1].astype(np.int32)
        bwt[sa == 0] = 0
        self.first = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(x, minlength=symbols), out=self.first[1:])
        self.wavelet = WaveletMatrix(bwt, symbols)
        sampled = (sa % step == 0) | (bwt == 0)
        self.marks = BitVector(sampled)
        self.samples = sa[sampled]

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows, filled up with zeros) at once: [low, high) in suffix order."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.first[-1])
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            c = patterns[on, lengths[on] - back]
            low[on] = self.first[c] + self.wavelet.rank(c, low[on])
            high[on] = self.first[c] + self.wavelet.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in suffix order."""
        out = np.zeros(len(rows), np.int64)
        left, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.marks.get(at)
            out[left[hit]] = self.samples[self.marks.rank(at[hit])] + walked
            left, at = left[~hit], at[~hit]
            c = self.wavelet.get(at)
            at = self.first[c] + self.wavelet.rank(c, at)
            walked += 1
        return out
