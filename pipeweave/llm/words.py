"""Vectorised word splitting and hashing of Arrow text columns.

A word is a run of bytes other than the six ASCII blanks (0x20, 0x09-0x0D). All hashes are 64 bits,
the same on every machine and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE = 1 << 20  # bytes hashed at a time; bounds memory, changes no result


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(name: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(name * 0xD1B54A32D192ED03 % (1 << 64)))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self._base = (base, pow(base, -1, 1 << 64))
        self._kept = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._kept[0]) < n:
            size = max(n, 2 * len(self._kept[0]))
            for i, b in enumerate(self._base):
                steps = np.full(size, b, dtype=_U)
                steps[0] = 1
                self._kept[i] = np.multiply.accumulate(steps)
        return self._kept[0][:n], self._kept[1][:n]


_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
_TABLE = seeds(1, 256) | _U(1)


def columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.fill_null("").cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


class Words:
    """The words of every row of a text column: byte ranges and the first word of each row."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        lo, hi = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
        self.data = data[lo:hi]
        at = at - lo
        n = len(self.data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        solid = ~_BLANK[self.data]
        before = np.concatenate(([False], solid[:-1])) if n else solid
        after = np.concatenate((solid[1:], [False])) if n else solid
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1 : n + 1])) + 1
        #: Row i has the words first[i] .. first[i + 1].
        self.first = np.searchsorted(self.start, at)
        self.at = at

    def hashes(self, lower: bool = False) -> np.ndarray:
        out = np.empty(len(self.start), dtype=_U)
        i, n = 0, len(self.start)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _SLICE, side="right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            part = self.data[lo:hi]
            part = _LOWER[part] if lower else part
            up, down = _BYTES.upto(hi - lo + 1)
            total = np.zeros(hi - lo + 1, dtype=_U)
            np.cumsum(_TABLE[part] * up[: hi - lo], out=total[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
            i = j
        return out


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words of one row, by their first word; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, dtype=_U)
    out = mix(h[: len(h) - k + 1])
    for i in range(1, k):
        out = mix(out + h[i : len(h) - k + 1 + i] * _U(0x9E3779B97F4A7C15) + _U(i))
    return out


class Ranges:
    """Hashes of any ranges of one row's words, each in constant time."""

    def __init__(self, h: np.ndarray) -> None:
        up, self.down = _WORDS.upto(len(h) + 1)
        self.total = np.zeros(len(h) + 1, dtype=_U)
        np.cumsum(mix(h + _U(0x5851F42D4C957F2D)) * up[: len(h)], out=self.total[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.total[e] - self.total[s]) * self.down[s] + (e - s).astype(_U))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
