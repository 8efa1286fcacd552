"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from emberspark.llm.common import LOWER

SLICE = 4 << 20
_rng = np.random.Generator(np.random.Philox(key=20240301))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word (maximal run without blanks, A-Z as a-z), in order."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + SLICE)
        while to < len(text) and not _SPACE[text[to]]:
            to += 1
        raw = np.frombuffer(text[at:to].translate(LOWER), np.uint8)
        at = to
        inside = ~_SPACE[raw]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first = np.flatnonzero(edge == 1)
        if not len(first):
            continue
        n = np.flatnonzero(edge == -1) - first
        byte = raw[inside]
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        place = np.arange(len(byte)) - np.repeat(start, n)
        value = (_BYTE[byte] + (place >> 12).astype(np.uint64) * _PLACE[63]) * _POWER[place & 4095]
        out.append(mix(np.add.reduceat(value, start) + n.astype(np.uint64) * _PLACE[62]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted hashes of the distinct k-word shingles; of a shorter text, of all its words as one."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        total += w[i:len(w) - k + 1 + i] * _PLACE[i]
    return np.unique(mix(total))


def minhash(hashes: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """``size`` minwise hashes of 32 bits of a non-empty set."""
    rng = np.random.Generator(np.random.Philox(key=seed))
    flip = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    times = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = hashes.astype(np.uint32)
    best = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 512):  # parts that stay in the processor's cache
        part = low[at:at + 512, None] ^ flip
        part *= times
        np.minimum(best, part.min(axis=0), out=best)
    return best
