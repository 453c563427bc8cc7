"""Suffix sorting in blocks with a difference cover.

Suffixes of the rows of a few whole buckets are sorted at once.  They are sorted
by their first PERIOD bytes; suffixes that tie are told apart by ranks that were
computed beforehand for a sample, the positions whose residue modulo PERIOD is in
the difference cover.  For any two positions some shift below PERIOD takes both into
the sample, so one comparison of ranks decides, whatever the length of the tie.
Memory is bounded by the block: ranks exist for the sample of a block only.
"""

from __future__ import annotations

import numpy as np

# A perfect difference set; every residue modulo 31 is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
NEAR, FAR = PERIOD << 3, PERIOD << 4  # bytes that the two ranks of a sample position look at


def shifts() -> np.ndarray:
    """shift[a, b]: the smallest d with a + d and b + d both in the cover, modulo PERIOD."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


SHIFT = shifts()


def words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number."""
    w = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    for reach in (1, 2, 4):
        w = (w[:-reach] << np.uint64(8 * reach)) | w[reach:]
    return w


def dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows by the keys (first key first): the order, and each sorted row's group number."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def head_keys(w: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Keys that order positions by their first PERIOD bytes."""
    return [w[at], w[at + 8], w[at + 16], w[at + PERIOD - 8]]


def sample_ranks(w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the first NEAR and the first FAR bytes of each sample position below n; -1 out of the sample.

    Each doubling sorts pairs of ranks; a position one step on is a sample position as well.
    """
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    rank = np.full(n + FAR, -1, np.int64)
    order, group = dense(*head_keys(w, at))
    rank[at[order]] = group
    size, near = PERIOD, rank
    while size < FAR:
        order, group = dense(rank[at], rank[at + size])
        rank = np.full(n + FAR, -1, np.int64)
        rank[at[order]] = group
        size *= 2
        if size == NEAR:
            near = rank
    return near, rank


def sort_ties(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the members of each group in suffix order by the sample's ranks: quicksort of all groups at once.

    ``at`` is sorted by group, and the members of a group tie over PERIOD bytes.
    """
    place = np.arange(len(at))  # where the members of the open groups stand
    out, home = at.copy(), group.copy()
    while len(at):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(at)])
        pivot = np.repeat(at[first + size // 2], size)
        d = SHIFT[at % PERIOD, pivot % PERIOD]
        side = np.sign(rank[at + d] - rank[pivot + d])
        order, sub = dense(group, side)
        at, side = at[order], side[order]
        out[place] = at
        count = np.bincount(sub)
        open_ = (side != 0) & (count[sub] > 1)
        at, group, place = at[open_], sub[open_], place[open_]
    return out, home


def only_ties(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.r_[True, group[1:] != group[:-1]] if len(at) else np.zeros(0, bool)
    tied = ~(new & np.r_[new[1:], True])
    return at[tied], group[tied]


def repeated_windows(text: np.ndarray, bucket: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Which of the windows text[i : i + span], i in ``at``, occur twice or more within their bucket.

    bucket is per position of ``text``; NEAR + PERIOD <= span <= FAR.
    """
    found = np.zeros(len(text) + 1, bool)
    if not len(at):
        return found[:0]
    w = np.r_[words(text), np.zeros(FAR, np.uint64)]
    order, group = dense(bucket[at], *head_keys(w, at))
    pos, group = only_ties(at[order], group)
    if len(pos):
        near, far = sample_ranks(w, len(text))
        pos, group = sort_ties(pos, group, far)
        # windows that are equal stand next to each other now
        k = np.flatnonzero(group[1:] == group[:-1])
        d = SHIFT[pos[k] % PERIOD, pos[k + 1] % PERIOD]
        k = k[near[pos[k] + d] == near[pos[k + 1] + d]]
        for o in [*range(NEAR, span - 8, 8), span - 8]:
            k = k[w[pos[k] + o] == w[pos[k + 1] + o]]
        found[pos[k]] = found[pos[k + 1]] = True
    return found[at]
