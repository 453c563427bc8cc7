"""Removal of repeated word windows against a count of all windows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import worddup
from corpusgraph.llm.tokens import bounds, hashes, joined

WORDS = [f"{a}{b}" for a in "al be co du en fi".split() for b in "ra to mi ne lu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [-(1 << 63) if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words):
        for j in range(len(w) - width + 1):
            g = tuple(w[j : j + width])
            least[g] = min(least.get(g, (1 << 63, 0)), (i, j))
    out = []
    for (doc, _), i, w in zip(rows, ids, words):
        gone = {k for j in range(len(w) - width + 1) if (i, j) > least[tuple(w[j : j + width])] for k in range(j, j + width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return collections.Counter(out)


def rows():
    """Copies, shared passages in many surroundings, short alphabets, nulls, odd bytes and long texts."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(5, 150)) for _ in range(20)]
    passage, line = prose(rng, 60), prose(rng, 9)
    texts = [*base, *base[:6], base[0], base[0]]
    texts += [f"{prose(rng, 20)}\n{passage}\t{prose(rng, 15)}" for _ in range(6)]
    texts += [f"{prose(rng, 14)} {line} {prose(rng, 14)}" for _ in range(30)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(25)]
    texts += [None, "", " ", "one", "x " * 300, "naïve 🦊 " * 30, "\x00\x01 " * 25, prose(rng, 3000), "é" * 5000]
    found = list(enumerate(texts))
    return [*found, (None, base[3]), (None, None), (5, base[5]), (5, base[7]), (-4, base[9])]


@pytest.mark.parametrize("width,gram,large", [(20, 5, 8192), (20, 5, 0), (3, 1, 2), (20, 20, 8192), (1, 1, 8192)])
def test_equals_brute_force(spark, width, gram, large):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("th", "h", "spans", "want", "first")})
    got = collections.Counter(tuple(r) for r in worddup.remove_repeated_windows(docs, width, gram, large, with_text=True).collect())
    assert got == brute(rows(), width)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = worddup.remove_repeated_windows(docs)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and out.count() == 0


def test_gram_has_to_fit(spark):
    with pytest.raises(ValueError):
        worddup.remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string"), 3, 4)


def test_words_of_a_batch():
    texts = [b"", b" a  bc\n", b"", b"d", b"ef", b"  "]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    start, end, doc = bounds(data, off)
    assert [(int(d), bytes(data[a:b])) for a, b, d in zip(start, end, doc)] == [(1, b"a"), (1, b"bc"), (3, b"d"), (4, b"ef")]
    flat, at = joined(data, start, end)
    assert bytes(flat) == b"a bc d ef " and at.tolist() == [0, 2, 5, 7, 10]
    same = np.frombuffer(b"xy zxy", np.uint8)
    h = hashes(same, np.array([0, 4, 3]), np.array([2, 6, 4]))
    assert h[0] == h[1] != h[2]


def test_equal_windows_share_minimiser_and_place():
    rng = random.Random(2)
    word = np.array([rng.randrange(1 << 60) for _ in range(50)] * 2 + [rng.randrange(1 << 60) for _ in range(10)], np.uint64)
    doc = np.repeat([0, 1, 2], [50, 50, 10])
    h, ch, first, last = worddup.super_kmers(word, doc, 20, 5)
    half = first < 50
    assert (h[half] == h[~half]).all() and (ch[half] == ch[~half]).all() and (first[half] + 50 == first[~half]).all()
    assert int((last - first + 1).sum()) == 2 * 31
    assert [len(x) for x in worddup.super_kmers(word[:19], doc[:19], 20, 5)] == [0] * 4


def test_ranks_tell_windows_apart():
    rng = random.Random(4)
    for width in (1, 2, 3, 20):
        word = np.array([rng.randrange(2) for _ in range(400)])
        rank = worddup.window_ranks(word, width)[: 401 - width]
        seen = {}
        for i, r in enumerate(rank.tolist()):
            assert seen.setdefault(r, tuple(word[i : i + width])) == tuple(word[i : i + width])
        assert len(seen) == len({tuple(word[i : i + width]) for i in range(401 - width)})
