"""Distinct word shingles of many texts at once, in numpy over the bytes of an Arrow column.

A word's hash is a polynomial of its lower-cased bytes modulo 2^64: prefix sums over a stretch of text give
those of all its words. A shingle's hash is a polynomial of its words' hashes. No Python string is made.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Bytes hashed together; a longer word is hashed by itself.
STRETCH = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Which bytes separate words; a number for each byte, A to Z like a to z; powers of the base and of its inverse; lower case."""
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256)
    lower[65:91] += 32
    number = scramble((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX)[lower]
    powers = np.full(STRETCH + 2, _BASE, np.uint64)
    inverse = np.full(STRETCH + 2, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return gap, number, np.multiply.accumulate(powers), np.multiply.accumulate(inverse), lower.astype(np.uint8).tobytes()


def _stretch(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a short stretch that holds whole words, and where each starts; words also end at the edges."""
    gap, number, powers, inverse, _ = _tables()
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    edge[0] = edge[-1] = True
    before = np.r_[False, inside[:-1]]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(number[data] * powers[: len(data)], out=sums[1:])
    return scramble((sums[end] - sums[start]) * inverse[start]), start


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of texts; text k lies between edges k and k + 1."""
    gap, _, _, _, lower = _tables()
    hashes, starts, at, size = [], [], int(edges[0]), int(edges[-1])
    while at < size:
        stop = min(size, at + STRETCH)
        if stop < size:
            # back to the last edge or separator; a word longer than a stretch goes alone
            edge = int(edges[np.searchsorted(edges, stop, "right") - 1])
            if edge > at:
                stop = edge
            else:
                gaps = np.flatnonzero(gap[data[at:stop]])
                if len(gaps) and gaps[-1]:
                    stop = at + int(gaps[-1])
                elif not len(gaps):
                    limit = int(edges[np.searchsorted(edges, at, "right")])
                    far = at
                    while far < limit and not (ends := np.flatnonzero(gap[data[far : min(limit, far + STRETCH)]])).size:
                        far = min(limit, far + STRETCH)
                    stop = far + int(ends[0]) if far < limit else limit
                    if stop - at > STRETCH:
                        hashes.append(np.array([xxh3_64_intdigest(data[at:stop].tobytes().translate(lower))], np.uint64))
                        starts.append(np.array([at]))
                        at = stop
                        continue
                else:
                    at += 1  # a separator before a long word
                    continue
        some, where = _stretch(data[at:stop], edges[(edges >= at) & (edges <= stop)] - at)
        hashes.append(some)
        starts.append(where + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``size`` words; with fewer words, of the whole sequence.

    Words are runs of characters other than space and \\x09 to \\x0D; A to Z count as a to z; null is empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    words, starts = _words(data, edges)
    cut = np.searchsorted(starts, edges)
    n = len(words) - size + 1
    rolled = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        rolled *= _MIX
        rolled += words[k : k + n]
    rolled = scramble(rolled)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(rolled[a : b - size + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            out.append(found[new])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                whole = whole * _MIX + w
            out.append(scramble(whole))
        else:
            out.append(words[:0])
    return out
