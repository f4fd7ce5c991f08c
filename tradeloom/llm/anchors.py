"""Content-chosen anchors: cut texts into runs of window starts that share their least gram."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

#: Bytes of a gram.
GRAM = 32
STEP = np.uint64(0x9E3779B97F4A7C15)
#: A bound on the starts of a run, and so on windows' length.
LONGEST_RUN = 4096


@lru_cache(1)
def byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * STEP)


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, STEP)
    up[0] = 1
    back = np.full(n, np.uint64(pow(int(STEP), -1, 1 << 64)))
    back[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(back)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of data[i : i + width] for each i that has one; width is a power of two."""
    h, n, step = byte_values()[data], 1, int(STEP)
    while n < width and len(h) > n:
        h = h[:-n] * np.uint64(step) + h[n:]
        step, n = step * step & (1 << 64) - 1, n * 2
    return mix64(h) if len(data) >= width else np.zeros(0, np.uint64)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """min(h[i : i + width]) for each i that has them all."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive window starts, within one text, whose windows of `length` bytes have the same least gram,
    at the same place (the first, of equals).

    Equal windows anywhere have equal keys and are never in one run. Returns key, hash of the run's bytes, text number, first start (in its
    text) and number of starts; the run's bytes are those of all its windows.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    grams = gram_hashes(data, GRAM)
    least = least_of(grams, length - GRAM + 1)
    inside = np.zeros(len(least) + 1, np.int8)
    size = np.diff(offsets)
    fits = size >= length
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[:-1][fits] + size[fits] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | ~inside[:-1]
    change[offsets[:-1][fits]] = True
    change |= ~inside
    heads = np.flatnonzero(change)
    span = np.diff(np.append(heads, len(least)))
    ok = inside[heads]
    heads, span = heads[ok], span[ok]
    up, back = powers(1 << max(16, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[:n], out=total[1:])
    stop = heads + span + length - 1
    digest = mix64((total[stop] - total[heads]) * back[heads] + span.astype(np.uint64))
    text = np.searchsorted(offsets, heads, "right") - 1
    return least[heads], digest, text, heads - offsets[text], span
