"""Ids in few bits: a canonical Huffman code, written and read as whole arrays.

Frequent ids get short codes, so sequences that travel alone are as short as the ids' frequencies allow; general codecs find
little in a sequence of a few hundred ids. Every sequence begins at a byte. Reading goes through all sequences at once,
one id of each at a time, with one table lookup for an id of any length.

Cases: a single symbol has a code of one bit; symbols that never occur have no code; a code is no longer than ``LONGEST`` bits, or than
twice as many codes need; up to 2^23 symbols, as a code and the 7 bits before it must fit in 32.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Bits of the longest code, unless half the codes of so many bits are too few.
LONGEST = 16


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Bits of each id's code; rare ids count as more frequent than they are until no code is too long."""
    least = 1
    while True:
        heap = [(max(int(n), least), k) for k, n in enumerate(counts)]
        heapq.heapify(heap)
        parent, at = [0] * (2 * len(heap)), len(heap)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heap[0]
            heapq.heapreplace(heap, (a + b, at))
            parent[i] = parent[j] = at
            at += 1
        depth = [0] * at
        for k in range(at - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        out = np.maximum(depth[:len(counts)], 1)
        if out.max() <= longest:
            return out
        least *= 2


class BitCode:
    """The code of symbols below ``len(counts)`` that occur ``counts`` times; symbol k is read as ``values[k]``."""

    def __init__(self, counts: np.ndarray, values: np.ndarray):
        used = np.flatnonzero(counts)
        self.longest = max(LONGEST, len(used).bit_length() + 1)
        self.length = np.zeros(len(counts), np.int64)
        self.length[used] = code_lengths(counts[used], self.longest)
        order = used[np.argsort(self.length[used], kind="stable")]
        spans = 1 << (self.longest - self.length[order])
        ends = np.cumsum(spans)
        self.code = np.zeros(len(counts), np.uint64)
        self.code[order] = ((ends - spans) >> (self.longest - self.length[order])).astype(np.uint64)
        # what any ``longest`` bits begin with: value * 64 + bits of its code
        self.first = np.zeros(1 << self.longest, np.int64)
        self.first[:ends[-1]] = np.repeat(values[order].astype(np.int64) * 64 + self.length[order], spans)

    def pack(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each sequence begins and ends) of sequences of ``sizes`` symbols, one or more each."""
        length = self.length[symbols]
        after = np.cumsum(length)
        bits = np.add.reduceat(length, np.cumsum(sizes) - sizes)
        offsets = np.concatenate(([0], np.cumsum((bits + 7) >> 3)))
        place = after - length + np.repeat(8 * offsets[:-1] - (np.cumsum(bits) - bits), sizes)
        word = place >> 5
        moved = self.code[symbols] << (64 - (place & 31) - length).astype(np.uint64)
        # codes that begin in the same 32 bits do not overlap; what reaches beyond goes to the next
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        both, word = np.add.reduceat(moved, cuts), word[cuts]
        out = np.zeros((int(offsets[-1]) + 3) // 4 + 1, np.uint32)
        out[word] = (both >> np.uint64(32)).astype(np.uint32)
        out[word + 1] |= both.astype(np.uint32)
        return out.astype(">u4").view(np.uint8)[:offsets[-1]], offsets

    def unpack(self, data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The rows of ``out``, row k beginning with the ``sizes[k]`` values of sequence k."""
        near = np.zeros(len(data) + 4, np.uint32)
        near[:len(data)] = data
        near = near[:-3] << 24 | near[1:-2] << 16 | near[2:-1] << 8 | near[3:]
        order = np.argsort(-sizes, kind="stable")
        place, falling, left = offsets[:-1][order] * 8, sizes[order], len(order)
        spare, most = 32 - self.longest, (1 << self.longest) - 1
        columns = np.empty((out.shape[1], len(order)), out.dtype)
        columns[:] = out[order].T
        for t in range(int(falling[0]) if left else 0):
            while falling[left - 1] <= t:
                left -= 1
            at = place[:left]
            found = self.first[near[at >> 3] >> (spare - (at & 7)) & most]
            columns[t, :left] = found >> 6
            at += found & 63
        out[order] = columns.T
        return out
