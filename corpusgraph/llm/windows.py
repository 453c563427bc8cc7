"""Content-defined runs of windows: the buckets of the suffix sort.

Every window of SPAN bytes is assigned to the occurrence of the smallest gram hash
in it (the rightmost of equals), so equal windows have equal grams at equal places
and meet in one bucket.  Windows that start next to each other share that
occurrence in runs.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

SPAN, GRAM = 400, 32
_FACTORS = {8: 0x9E3779B97F4A7C15, 16: 0xC2B2AE3D27D4EB4F}


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on; the last GRAM - 1 positions have none."""
    with np.errstate(over="ignore"):
        g = data.astype(np.uint64)
        reach = 1
        while reach < GRAM:  # twice as many bytes from two halves: packed up to 8, hashed beyond
            g = (g[:-reach] << np.uint64(8 * reach)) | g[reach:] if reach < 8 else g[:-reach] * np.uint64(_FACTORS[reach]) + g[reach:]
            reach *= 2
        return mix64(g)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the smallest of h[i : i + w] by its upper 32 bits, the rightmost of equals."""
    low = np.uint64(0xFFFFFFFF)
    x = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    reach = 1
    while 2 * reach <= w:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    if w > reach:
        x = np.minimum(x[: len(x) - (w - reach)], x[w - reach :])
    return (low - (x & low)).astype(np.int64)


def runs(data: np.ndarray, off: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one gram occurrence: document, first and last window start (flat), gram place, gram hash."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    h = grams(data)
    pick = sliding_argmin(h, span - GRAM + 1)[: n - span + 1]
    # a run ends where the gram changes or the document does
    change = np.r_[True, pick[1:] != pick[:-1]]
    change[off[:-1][np.diff(off) >= span]] = True
    first = np.flatnonzero(change)
    doc = np.searchsorted(off, first, "right") - 1
    last = np.minimum(np.r_[first[1:], len(pick)] - 1, off[doc + 1] - span)
    inside = last >= first  # the others begin where no window fits into the document any more
    doc, first, last = doc[inside], first[inside], last[inside]
    return doc, first, last, pick[first], h[pick[first]]
