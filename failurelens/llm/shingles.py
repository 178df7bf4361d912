"""Word sequences as 64-bit numbers, for whole texts at once.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial in random
64-bit byte values, modulo 2**64: differences of running sums over the text give all
words' hashes without a Python object for each word.
"""

from __future__ import annotations

import numpy as np

#: Texts are hashed in pieces of about this many bytes, cut between words.
PIECE = 1 << 19
_RNG = np.random.default_rng(20)
_ODD = (_RNG.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)
_VALUE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LETTER = np.ones(256, bool)
_LETTER[[9, 10, 11, 12, 13, 32]] = False
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1024)
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = pair
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _piece_hashes(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each word, its hash) of a piece that cuts no word."""
    letter = _LETTER[piece]
    edge = np.diff(letter, prepend=False, append=False)
    places = np.flatnonzero(edge)
    first, end = places[::2], places[1::2]
    power, inverse = _powers(len(piece) + 1)
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_VALUE[piece] * power[:len(piece)], out=sums[1:])
    h = (sums[end] - sums[first]) * inverse[first]
    return first, mix(h + (end - first).astype(np.uint64) * _ODD[0])


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    firsts, hashes, at = [], [], 0
    while at < len(joined):
        end = min(at + PIECE, len(joined))
        if end < len(joined):  # a piece ends with white space
            while True:
                gap = np.flatnonzero(~_LETTER[joined[max(at, end - 1024):end]])
                if len(gap):
                    end = max(at, end - 1024) + int(gap[-1]) + 1
                    break
                more = np.flatnonzero(~_LETTER[joined[end:end + PIECE]])
                if len(more):
                    end += int(more[0]) + 1
                    break
                end = min(end + PIECE, len(joined))
                if end == len(joined):
                    break
        first, h = _piece_hashes(joined[at:end])
        firsts.append(first + at)
        hashes.append(h)
        at = end
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    bounds = np.searchsorted(first, starts)
    return [every[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of ``k`` consecutive words; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h += words[j:j + n] * _ODD[j]
    return mix(h)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; of fewer words the whole sequence as one; of none, none."""
    return np.unique(sequence_hashes(words, min(k, len(words)))) if len(words) else np.zeros(0, np.uint64)
