"""Words, shingles and slices of texts in numpy, a whole Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bytes that separate words: space and \x09 to \x0D.
SEPARATORS = b" \t\n\r\x0b\x0c"
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_SHINGLE = np.uint64(0x2545F4914F6CDD1D)


def _table(fold: bool) -> np.ndarray:
    t = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
    if fold:
        t[65:91] = t[97:123]
    return t


_EXACT, _FOLDED = _table(False), _table(True)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1), from the first 48 bits of a digest of a string column."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + seed))), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of at most ``most`` bytes, or of one text that is longer."""
    if len(texts) == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after another, and where each begins; null counts as empty."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _powers(n: int, b: np.uint64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            k = min(have, n - have)
            out[have : have + k] = out[:k] * (out[have - 1] * b)
            have += k
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and for each text the index of its first word (one more entry at the end).
    ``fold``: A to Z count as a to z."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _EXACT)[data] * _powers(n, _BASE), out=total[1:])
        hashes = mix((total[end] - total[start]) * _powers(n, _BASE_INV)[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, wherever texts end."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _SHINGLE + words[j : j + n]
        return mix(out)


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles (case folded for A to Z); with fewer words
    the whole sequence is one shingle; without words the set is empty."""
    data, offsets = raw_bytes(texts)
    words, first = word_hashes(data, offsets, fold=True)
    windows, out = window_hashes(words, k), []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            s = np.sort(windows[a : b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix(window_hashes(words[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
