"""Hashes of many byte spans at once: polynomials modulo 2^64 from prefix sums, then mixed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, back = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    base[0] = back[0] = 1
    return np.cumprod(base), np.cumprod(back)


_cached = _powers(1 << 16)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of buf[start:end] for each (starts, ends)."""
    global _cached
    if len(buf) + 1 > len(_cached[0]):
        _cached = _powers(len(buf) + 1)
    forth, back = _cached
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(buf * forth[: len(buf)], out=prefix[1:])
    return [mix((prefix[e] - prefix[s]) * back[s]) for s, e in spans]


def runs_of(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], dark.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def fold(id_: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % parts


def share(id_: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the id and the salt alone."""
    return F.pmod(F.xxhash64(id_, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))

