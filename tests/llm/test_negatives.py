"""Hard negatives against scoring all pairs."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, most_negatives=10, least=30, most=90):
    ok = set()
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) or abs(x) >= 2**18 for x in v):
            continue
        ok.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = collections.Counter()
    for a, label, q in ok:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, l, v) for i, l, v in ok if len(v) == len(q)]
        for s, p, _, _ in sorted((s, i, l, list(v)) for s, i, l, v in scored if l == label and i != a)[:positives]:
            inside = sorted((n, i, l, list(v)) for n, i, l, v in scored if l != label and least * -s <= 100 * -n <= most * -s)
            out.update((a, p, r, i, -s, -n) for r, (n, i, _, _) in enumerate(inside[:most_negatives], 1))
    return out


def vectors(seed, n=420, d=12):
    """Clusters, ties, repeated rows and ids, other lengths, nulls, far values."""
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = [(i, rng.randrange(10), [x + rng.gauss(0, 0.4) for x in rng.choice(centre)]) for i in range(n)]
    rows += [(n + i, i % 10, rows[100][2]) for i in range(30)] + [(200, 3, rows[100][2]), (200, 4, rows[7][2])] + rows[100:103] * 2
    rows += [(1000, 1, [0.0] * d), (1001, 1, [0.0] * d), (1002, 2, [0.0] * d)]
    rows += [(1100 + i, i % 3, [rng.gauss(0, 1) for _ in range(3)]) for i in range(12)]
    rows += [(1200, 1, None), (1300, None, rows[0][2]), (None, 1, rows[0][2]), (1400, 1, []), (1500, 1, [math.nan] * d), (1600, 1, [math.inf] + [0.0] * (d - 1)), (1700, 1, [None] * d), (1800, 1, [1e30] * d)]
    rows += [(1900, 5, [1000.0] * d), (1901, 5, [900.0] * d), (1902, 6, [500.0] * d)]
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"anchors_a_block": 2, "rows_a_block": 50})])
def test_equals_all_pairs(spark, seed, sizes):
    rows = spark.createDataFrame(vectors(seed), SCHEMA).withColumns({c: F.lit("x") for c in ("d", "code", "ab", "score")})
    got = collections.Counter(tuple(r) for r in negatives.hard_negatives(negatives.relabel(rows), F.col("vec_id") % 100 == 0, **sizes).collect())
    assert got == brute(vectors(seed)) and got


def test_other_bands(spark):
    rows = spark.createDataFrame(vectors(3), SCHEMA)
    got = collections.Counter(tuple(r) for r in negatives.hard_negatives(negatives.relabel(rows), F.col("vec_id") % 100 == 0, 2, 3, 50, 120).collect())
    assert got == brute(vectors(3), 2, 3, 50, 120)


def test_empty_table(spark):
    out = negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0)
    assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("d", [1, 3, 64, 100, 200])
def test_intervals_hold_all_scores(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, 0, rng.standard_normal(d).tolist()) for i in range(300)] + [(300, 0, [0.0] * d), (301, 0, [1.0] + [0.0] * (d - 1))]
    t = negatives.encode(spark.createDataFrame(rows, SCHEMA)).toArrow()
    block = negatives.Block(t, d)
    low, high = negatives.intervals(block.ints[:40].astype(float), block)
    score = block.ints[:40] @ block.ints.T
    assert (low <= score).all() and (score <= high).all()
    if d >= 64:  # and they are narrower than what lengths alone tell
        size = np.sqrt((block.ints**2).sum(axis=1))
        assert np.median((high - low) / (2 * size[:40, None] * np.maximum(size, 1))) < 0.65


def test_rotation_keeps_products():
    r = negatives.rotation(64)
    assert np.allclose(r @ r.T, np.eye(64))


def test_ties_go_to_smaller_ids():
    assert negatives.best(np.array([5, 3, 9]), np.array([7, 7, 8]), [], 2).tolist() == [2, 1]
    assert negatives.best(np.array([5, 5, 4]), np.array([7, 7, 7]), [(2, b""), (1, b""), (0, b"")], 3).tolist() == [2, 1, 0]
    assert isinstance(negatives._table([], negatives._TOLD), pa.Table)
