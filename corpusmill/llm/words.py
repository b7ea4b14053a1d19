"""Words of many texts at once, as 64-bit hashes, with numpy only.

A word is a run of ASCII letters (A-Z lower-cased), ASCII digits and bytes of non-ASCII characters: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+
after lower-casing. The hash of a word depends on its bytes alone.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
#: 0: control characters and space, 1: in words, 2: other
_KIND = np.where(_IS_WORD, 1, np.where((np.arange(256) > 32) & (np.arange(256) != 127), 2, 0)).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def run_bounds(kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end byte of each run of equal kinds but 0; runs end where their text ends."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some, change = kinds > 0, np.ones(n + 1, bool)
    change[1:n] = kinds[1:] != kinds[:-1]
    change[at[(at > 0) & (at < n)]] = True
    return np.flatnonzero(some & change[:-1]), np.flatnonzero(some & change[1:]) + 1


#: Bytes that are hashed at a time: what a very long text takes beside itself doesn't grow with it, nor do the tables of powers that a worker keeps (16 bytes for each).
_BLOCK = 1 << 20


def _hashes(data: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins, ends = run_bounds(kinds, at)
    out = np.empty(len(begins), np.uint64)
    k = 0
    while k < len(begins):
        to = max(k + 1, int(np.searchsorted(ends, begins[k] + _BLOCK, "right")))
        base = begins[k]
        b, e = begins[k:to] - base, ends[k:to] - base
        power, unpower = _power_tables(int(e[-1]) + 1)
        sums = np.empty(int(e[-1]) + 1, np.uint64)
        sums[0] = 0
        np.multiply(data[base : base + e[-1]], power[: e[-1]], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        out[k:to] = mix((sums[e] - sums[b]) * unpower[b] + (e - b).astype(np.uint64))
        k = to
    return out, np.searchsorted(begins, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts in data, and the index of each text's first word (one more entry than texts)."""
    return _hashes(_LOWER[data], _IS_WORD[data].view(np.uint8), at)


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, for case-sensitive words and runs of other printable characters."""
    return _hashes(data, _KIND[data], at)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, text by text, and each text's first; a text of fewer words, but not none, is one shingle."""
    n, count = len(words), np.diff(first)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h[: max(0, n - j)] += mix(words[j:] + np.uint64(j + 1))
    doc = doc_of(first)
    whole = np.arange(n) + k <= first[1:][doc]
    short = np.flatnonzero((count > 0) & (count < k))
    for d in short:
        w = words[first[d] : first[d + 1]]
        h[first[d]] = mix(w + np.arange(1, len(w) + 1, dtype=np.uint64)).sum(dtype=np.uint64)
    whole[first[:-1][short]] = True
    out = np.zeros(len(first), np.int64)
    np.cumsum(np.bincount(doc[whole], minlength=len(first) - 1), out=out[1:])
    return mix(h[whole]), out
