"""A compressed FM-index of one shard of word sequences, searched for many queries at once.

Suffixes are sorted by their first ``depth`` words, which is enough for backward search of
patterns up to that length. The Burrows-Wheeler words are held in a wavelet matrix: one
packed bit vector for each bit of the word numbers, with counts by 64-bit block.
"""

from __future__ import annotations

import numpy as np

#: One bits in a number's low i bits.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with constant-time counts of the ones before a place."""

    def __init__(self, ones: np.ndarray):
        padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
        padded[:len(ones)] = ones
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & _BELOW[at & 63])


class FmIndex:
    """Index of ``text`` (word numbers from 1; 0 separates sequences)."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth = depth
        n = len(text)
        padded = np.concatenate([text, np.zeros(depth + 1, text.dtype)])
        rank = _sorted_ranks(text.astype(np.int64), depth)
        self.suffixes = np.argsort(rank, kind="stable")
        # common first words of neighbouring suffixes, up to depth
        self.common = np.zeros(n, np.int8)
        same = np.ones(n - 1, bool)
        for d in range(depth):
            same &= padded[self.suffixes[1:] + d] == padded[self.suffixes[:-1] + d]
            self.common[1:] += same
        self.groups = {}
        last = text[self.suffixes - 1]
        self.size = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        self.levels = []
        for bit in range(max(1, (self.size - 1).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), int(n - ones.sum())))
            last = np.concatenate([last[~ones], last[ones]])
        every = np.arange(self.size)
        self.start = self._walk(every, np.zeros(self.size, np.int64))

    def _walk(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Down the wavelet matrix: where the words equal to ``word`` before ``at`` end."""
        for bit, bits, zeros in self.levels:
            ones = bits.ones_before(at)
            at = np.where((word >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that start with ``word`` and go on with one in [low, high)."""
        known = word < self.size
        word = np.where(known, word, 0)
        base = self.first[word] - self.start[word]
        new_low, new_high = base + self._walk(word, low), base + self._walk(word, high)
        return new_low, np.where(known, new_high, new_low)

    def group(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(group of each suffix, where groups start and the last ends) by the first ``length`` words."""
        if length not in self.groups:
            new = self.common < length
            new[0] = True
            self.groups[length] = (np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(new)))
        return self.groups[length]

    def shorten(self, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first ``length`` words of the suffix at ``low``."""
        of, bounds = self.group(length)
        return bounds[of[low]], bounds[of[low] + 1]

    def matching_statistics(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each query the length, up to ``depth``, of the longest match that starts there,
        and a suffix that starts with it. ``queries``: one to a row, 0 beyond its length."""
        rows, width = queries.shape
        match, where = np.zeros((rows, width), np.int8), np.zeros((rows, width), np.int64)
        low, high = np.zeros(rows, np.int64), np.full(rows, len(self.suffixes))
        held = np.zeros(rows, np.int64)
        for place in range(width - 1, -1, -1):
            live = np.flatnonzero(place < lengths)
            # a match of full depth gives up its last word to take one in front
            full = live[held[live] == self.depth]
            if len(full):
                low[full], high[full] = self.shorten(low[full], self.depth - 1)
                held[full] -= 1
            word = queries[live, place]
            new_low, new_high = self.step(word, low[live], high[live])
            lost = new_low >= new_high
            while lost.any():
                at = live[lost]
                gone = held[at] == 0  # not even the word alone occurs
                for d in np.unique(held[at][~gone]):
                    some = at[held[at] == d]
                    low[some], high[some] = self.shorten(low[some], int(d) - 1) if d > 1 else (0, len(self.suffixes))
                held[at] = np.maximum(held[at] - 1, 0)
                again = np.flatnonzero(lost)
                new_low[again], new_high[again] = self.step(word[again], low[at], high[at])
                lost[again] = (new_low[again] >= new_high[again]) & ~gone
            found = new_low < new_high
            low[live] = np.where(found, new_low, 0)
            high[live] = np.where(found, new_high, len(self.suffixes))
            held[live] = np.where(found, held[live] + 1, 0)
            match[live, place], where[live, place] = held[live], low[live]
        return match, where

    def least(self, values: np.ndarray, length: int) -> np.ndarray:
        """For each suffix the least of ``values`` (by place in the text) over its group."""
        of, bounds = self.group(length)
        return np.minimum.reduceat(values[self.suffixes], bounds[:-1])[of]


def _sorted_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``depth`` symbols; equal first symbols share a rank."""
    rank, known = symbols, 1
    while known < depth:
        ahead = min(known, depth - known)
        following = np.concatenate([rank[ahead:], np.zeros(ahead, np.int64)])
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + following, return_inverse=True)
        rank, known = rank.ravel().astype(np.int64), known + ahead
    return rank
