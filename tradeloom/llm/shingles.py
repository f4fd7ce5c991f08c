"""Words and word shingles of text chunks, vectorised over many documents."""

from __future__ import annotations

import numpy as np

from .anchors import STEP, byte_values, powers
from .common import mix64

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, ends, first): words are text[starts:ends], joined by one blank each; the words of
    document i are first[i] .. first[i + 1]. Words end at documents' ends."""
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] |= solid[heads]
    at = np.flatnonzero(begins)
    order = np.cumsum(solid) - 1  # place among the bytes that stay
    starts = order[at] + np.arange(len(at))  # one blank before each word but the first
    kept = LOWER[data[solid]] if lower else data[solid]
    text = np.full(len(kept) + max(0, len(at) - 1), 32, np.uint8)
    word_of = np.cumsum(begins)[solid] - 1
    text[np.arange(len(kept)) + word_of] = kept
    ends = np.append(starts[1:] - 1, len(text)) if len(at) else starts
    return text, starts, ends, np.searchsorted(at, offsets)


def spans(first: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, owner) of each shingle of `width` words; fewer words: the whole sequence; none: none."""
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(at + width, first[1:][owner]) - 1
    return starts[at], ends[last], owner


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of words()."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(starts, len(text)))
    place = np.arange(len(text)) - np.repeat(starts, size)
    up, _ = powers(1 << max(12, int(size.max()).bit_length()))
    mixed = byte_values()[text] * up[place]
    mixed[ends[:-1]] = 0  # the blanks between words
    return mix64(np.add.reduceat(mixed, starts) ^ (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of each shingle of `width` words, from words' hashes; fewer words: the whole sequence."""
    at, _, owner = spans(first, np.arange(len(h)), np.arange(len(h)), width)
    stop, out = first[1:][owner], np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < stop
        out = mix64(out * STEP + np.where(inside, h[np.minimum(at + k, len(h) - 1)], np.uint64(0)) + np.uint64(1))
    return out, owner
