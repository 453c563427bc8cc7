"""Phrase mining against counting by hand."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, longest=3, low=10, part=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= low}
    inside = collections.Counter()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    best = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * inside[lang, p] >= part * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        best[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, p.decode(), -a, lf, rt, n[lang], -s) for lang, x in best.items() for r, (s, a, p, lf, rt) in enumerate(sorted(x)[:top], 1)}


def rows(seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "naïve", "🦊", "x|y", "a", "b", "é", "-"]
    out = []
    for i in range(140):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "? "]) for _ in range(rng.randrange(60)))
        out.append((i, t + " new york city" * rng.randrange(3), rng.choice(["en", "fr", None, "und"])))
    return [*out, (1, None, "en"), (2, "", None), (3, " \t.,", "en"), (None, "the of " * 3000, "xx"), out[0], out[0], (9, "one", "de")]


@pytest.mark.parametrize("sizes", [{}, {"hot": 30, "block": 500}, {"hot": 10**9, "block": 50, "limit": 100}, {"hot": 1, "block": 200, "limit": 300}])
def test_equals_counting(spark, sizes):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(7).withColumns({c: F.lit("x") for c in ("phrase", "f", "n", "route", "word")})
    assert {tuple(r) for r in phrases.collocations(docs, **sizes).collect()} == brute(rows())


@pytest.mark.parametrize("longest,low,part,top", [(2, 3, 50, 2000), (4, 5, 80, 7), (5, 2, 100, None)])
def test_other_lengths(spark, longest, low, part, top):
    got = phrases.collocations(spark.createDataFrame(rows(2), SCHEMA).repartition(3), longest, low, part, top, hot=40, block=2000)
    assert {tuple(r) for r in got.collect()} == brute(rows(2), longest, low, part, top)


def test_empty_and_wrong(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "one", "en")], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(empty, longest=1)


def test_products_beyond_64_bits(spark, monkeypatch):
    a, l, r = 3_000_000_007, 4_000_000_011, 5_000_000_029
    rows = [("en", "u v", a), ("en", "u", l), ("en", "v", r), ("en", None, 10**12)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_, **__: spark.createDataFrame(rows, "lang string, phrase string, f long"))
    assert [tuple(x) for x in phrases.collocations(None).collect()] == [("en", 1, "u v", a, l, r, 10**12, 10**6 * a * a // (l * r))]


def test_partitions_count_prefixes():
    rng = np.random.default_rng(3)
    keys = rng.integers(-1, 4, (3, 500))
    keys[2][keys[1] < 0] = -1
    keys[0] = np.abs(keys[0])
    weight, group = rng.integers(1, 5, 500), rng.integers(0, 6, 500)
    for low in (1, 12):
        depth, at, total = phrases.partitions(keys, weight, group, np.full((3, 500), low))
        got = {(int(group[i]), *keys[:d, i].tolist()): int(t) for d, i, t in zip(depth.tolist(), at.tolist(), total)}
        want = collections.Counter()
        for i in range(500):
            for d in range(1, 4):
                if (keys[:d, i] >= 0).all():
                    want[(int(group[i]), *keys[:d, i].tolist())] += int(weight[i])
        assert len(got) == len(depth) and got == {k: v for k, v in want.items() if v >= low}
