"""Words of a batch of texts as flat numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import mix64, ranges

_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_set(outside: bytes) -> np.ndarray:
    """For each byte whether it belongs to a word: all but ``outside``, which are ASCII."""
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    return inside


#: A word is a maximal run of anything but blank, tab, line feed, vertical tab, form feed and return.
PLAIN = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")


def bounds(data: np.ndarray, off: np.ndarray, inside: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the text it is in; ``off`` are the n + 1 borders of the texts."""
    w = inside[data]
    before, after = np.r_[False, w[:-1]], np.r_[w[1:], False]
    edge = off[:-1][np.diff(off) > 0]
    before[edge] = False
    after[edge[1:] - 1] = False
    start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, for choosing places only: equality is always told by bytes."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _BASE)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64)))])
        total = np.r_[np.uint64(0), np.cumsum(mix64(data.astype(np.uint64) + _BASE) * power[: len(data)])]
        return mix64((total[end] - total[start]) * back[start])


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one blank after each, and the n + 1 places where words begin."""
    size = end - start
    at = np.r_[0, np.cumsum(size + 1)]
    out = np.full(int(at[-1]), 32, np.uint8)
    out[ranges(at[:-1], size)] = data[ranges(start, size)]
    return out, at
