"""Vectorised word and shingle hashing of UTF-8 text, used inside Arrow tasks.

Words are runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z. A word's hash is
a polynomial over its bytes modulo 2**64, mixed; a shingle's hash combines the hashes of its words
in order. Equal shingles always have equal hashes; different ones collide with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows with the longest text seen."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        table = np.full(size, base, dtype=_U)
        table[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(table)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """One uint64 per word, in order."""
    raw = LOWER[np.frombuffer(text, dtype=np.uint8)]
    inside = np.concatenate(([False], ~SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.empty(0, dtype=_U)
    start, end = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate(([_U(0)], np.cumsum((raw.astype(_U) + _U(1)) * _power(_BASE, len(raw)))))
        own = (sums[end] - sums[start]) * _power(_INVERSE, len(raw))[start]
        return mix(own + (end - start).astype(_U))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; the whole sequence as one if there are fewer; none without words."""
    if not len(words):
        return words
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, dtype=_U)
        for i in range(n):
            out = mix(out * _U(_BASE) + words[i : len(words) - n + 1 + i])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64) of a text; empty for null."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode()), size))


#: Bytes of text hashed at a time; a longer text is taken alone.
CHUNK = 1 << 20


def _chunk(raw: np.ndarray, cuts: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text raw[cuts[i]:cuts[i + 1]]."""
    n = len(raw)
    raw = LOWER[raw]
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[raw], out=inside[1:-1])
    first = np.zeros(n + 1, dtype=bool)
    first[cuts] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=_U)
        sums[0] = 0
        np.cumsum((raw.astype(_U) + _U(1)) * _power(_BASE, n), out=sums[1:])
        words = mix((sums[end] - sums[start]) * _power(_INVERSE, n)[start] + (end - start).astype(_U))
    at = np.searchsorted(start, cuts)
    every = shingle_hashes(words, size) if len(words) >= size else None
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(every[i : j - size + 1] if j - i >= size else shingle_hashes(words[i:j], size)))
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """shingle_set() of each text of an Arrow column, many texts at a time."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield from _chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
        i = j
