"""The classifier against a slow n-gram regression in plain Python."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import quality

MASK = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def slow_features(text):
    """Share of a text's n-grams in each bin, family by family."""
    raw = (text or "").encode()
    words = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        words.append(mix(sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w)) & MASK))
    families = [words, [(a * 31 + b) & MASK for a, b in zip(words, words[1:])]]
    for n in quality.ORDERS:
        families.append([(n << 8 * n | int.from_bytes(raw[i : i + n], "big")) & MASK for i in range(len(raw) - n + 1)])
    out = {}
    for f, grams in enumerate(families):
        for b, k in collections.Counter(mix(g) >> 52 for g in grams).items():
            out[f * quality.BINS + b] = k / len(grams)
    return out


def slow_fit(rows, labels, penalty=1e-3, steps=300):
    """Adam on the penalised log loss in double precision: weights of scaled features, bias."""
    scale = collections.defaultdict(float)
    for r in rows:
        for k, x in r.items():
            scale[k] += x * x
    scale = {k: math.sqrt(s / len(rows)) + 1e-4 for k, s in scale.items()}
    rows = [{k: x / scale[k] for k, x in r.items()} for r in rows]
    each = {c: 0.5 / max(1, labels.count(c)) for c in (0, 1)}
    w, m, v = ({k: 0.0 for k in scale} for _ in range(3))
    b = mb = vb = 0.0
    for t in range(1, steps + 1):
        g, gb = {k: penalty * x for k, x in w.items()}, 0.0
        for r, y in zip(rows, labels):
            e = each[y] * (1 / (1 + math.exp(-sum(w[k] * x for k, x in r.items()) - b)) - y)
            gb += e
            for k, x in r.items():
                g[k] += e * x
        rate = 0.05 * (1 - t / (steps + 1))
        for k, d in [*g.items()]:
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
            w[k] -= rate * m[k] / (1 - 0.9**t) / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= rate * mb / (1 - 0.9**t) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return {k: x / scale[k] for k, x in w.items()}, b


def test_scores_equal_a_slow_regression(spark):
    rng = random.Random(9)
    good, bad = "the a of to in ré".split(), "win $$$ click ### free 🦊".split()
    rows = []
    for i in range(60):
        y = i % 2
        text = " ".join(rng.choice(good if rng.random() < (0.75 if y else 0.3) else bad) for _ in range(rng.randrange(8, 25)))
        rows.append((i, text, 1 - y if i % 9 == 0 else y))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["quality_prob"] for r in quality.rate_quality(docs, labels).collect()}
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    x, y = {i: slow_features(t) for i, t, _ in rows} | {900: {}, 901: {}}, {i: c for i, _, c in rows}
    trained, rest = ([i for i in sorted(y, key=h.get) if (h[i] % 4 == 0) == held] for held in (False, True))
    w, b = slow_fit([x[i] for i in trained], [y[i] for i in trained])
    z = {i: b + sum(w.get(k, 0.0) * s for k, s in r.items()) for i, r in x.items()}
    # the Platt curve: where the slope of the loss is nought
    pos = sum(y[i] for i in rest)
    target = {i: (pos + 1) / (pos + 2) if y[i] else 1 / (len(rest) - pos + 2) for i in rest}
    a, c = 0.0, 0.0
    for _ in range(200):
        p = {i: 1 / (1 + math.exp(-a * z[i] - c)) for i in rest}
        g = [sum((p[i] - target[i]) * z[i] for i in rest), sum(p[i] - target[i] for i in rest)]
        q = {i: p[i] * (1 - p[i]) for i in rest}
        hess = [sum(q[i] * z[i] ** 2 for i in rest), sum(q[i] * z[i] for i in rest), sum(q.values())]
        det = hess[0] * hess[2] - hess[1] ** 2
        a, c = a - 0.5 * (hess[2] * g[0] - hess[1] * g[1]) / det, c - 0.5 * (hess[0] * g[1] - hess[1] * g[0]) / det
    for i in x:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-a * z[i] - c)), abs=0.01), i
    assert 0 < pos < len(rest) and max(got.values()) - min(got.values()) > 0.3
