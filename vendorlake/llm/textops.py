"""Vectorised word handling over Arrow string batches (inside Spark tasks).

Words are runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 equals
the code point pattern of the contracts.  Words are compared by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1             # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 2 ** 64)
_STEP = _U(0xD6E8FEB86659FD93)
_PIECE = 1 << 20                         # bytes hashed at once


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_UP, _DOWN = _powers(_P, _PIECE + 1), _powers(_P_INV, _PIECE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] per word, in pieces of bounded memory."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _PIECE, "right")))
        n = int(ends[j - 1] - lo)
        up, down = (_UP, _DOWN) if n <= _PIECE else (_powers(_P, n + 1), _powers(_P_INV, n + 1))
        sums = np.zeros(n + 1, _U)
        np.cumsum((data[lo:lo + n].astype(_U) + _U(1)) * up[:n], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _STEP)
        i = j
    return out


class Words:
    """The words of some texts: hash, bytes start/end and first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        kind = np.int64 if wide else np.int32
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
            if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]              # first byte of each text, and the end
        self.raw = data
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
        before[1:] = ~inside
        after[:max(len(data) - 1, 0)] = ~inside[1:]
        before[self.at[:-1]] = True
        after[self.at[1:] - 1] = True               # index -1 is the unused last one
        self.inside = inside
        self.starts = np.flatnonzero(inside & before[:-1])
        self.ends = np.flatnonzero(inside & after[:-1]) + 1
        self.first = np.searchsorted(self.starts, self.at)   # first word of each text, and the end
        self.counts = np.diff(self.first)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = hash_words(self.data, self.starts, self.ends)
        return self._hashes

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words that lies in one text."""
        h = rolling(self.hashes, k)
        left = np.repeat(self.first[1:], self.counts)[:len(h)] - np.arange(len(h))
        at = np.flatnonzero(left >= k)
        return at, h[at]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    power, have, step = h, 0, 1            # power: hash of `step` values from i on
    factor = 0xC2B2AE3D27D4EB4F            # multiplier to the power of `step`
    out = np.zeros(len(h), _U)
    rest = k
    while rest:
        if rest & 1:
            piece = power[have:have + n]
            out = out[:n] * _U(factor) + piece
            have += step
        rest >>= 1
        if rest:
            power = power[:len(power) - step] * _U(factor) + power[step:]
            step, factor = step * 2, factor * factor % 2 ** 64
    return mix(out[:n] + _U(k))


def pieces(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) over the rows, of about ``limit`` bytes of text each."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(texts):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield i, texts.slice(i, j - i)
        i = j

