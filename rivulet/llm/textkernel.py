"""Vectorised byte-level text routines: words, hashes, shingles.

All work on UTF-8 bytes in numpy arrays.  Separators and letters of the contracts are ASCII, so
byte classes give the same words as character classes.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)

#: Bytes of `[^\x20\x09-\x0D]+`.
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The hash base's first n powers."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE, U64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def spans(text: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = member[text]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def run_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; runs are sorted and don't overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first - starts, lens)
    terms = _BYTE[text[at]] * powers(int(lens.max()))[at - np.repeat(starts, lens)]
    return mix(np.add.reduceat(terms, first) + lens.astype(U64) * _BYTE[0])


#: The base's inverse modulo 2^64.
_UNDO = U64(pow(int(_BASE), -1, 1 << 64))
_back = np.ones(1, U64)


def _inverse_powers(n: int) -> np.ndarray:
    global _back
    if len(_back) < n:
        steps = np.full(max(n, 2 * len(_back)), _UNDO, U64)
        steps[0] = 1
        _back = np.multiply.accumulate(steps)
    return _back[:n]


def all_words(text: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of the words of many texts in one buffer.

    Text i has the words first[i] to first[i + 1].  Hashes are those of run_hashes(): differences of
    prefix sums, times the base's inverse power of where the word starts.
    """
    n = len(text)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = member[text]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True  # words don't go on from one text to the next
    step = inside[1:] != inside[:-1]
    starts = np.flatnonzero(inside[1:] & (step | cut))
    ends = np.flatnonzero(inside[:-1] & (step | cut))
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[text] * powers(n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _inverse_powers(n + 1)[starts] + (ends - starts).astype(U64) * _BYTE[0])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(text: np.ndarray, member: np.ndarray = WORD) -> np.ndarray:
    return run_hashes(text, *spans(text, member))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(k):
        h = h * _BASE + words[j : j + n]
    return mix(h + U64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle, none give none."""
    if len(words) == 0:
        return words
    return np.unique(gram_hashes(words, min(k, len(words))))


def lane_hash(text: str) -> int:
    """A 64-bit hash of a short string, the same in every process."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return int(run_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 1
