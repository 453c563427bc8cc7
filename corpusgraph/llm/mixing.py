"""Mixing sources to target weights by the cube method.

Sources share a budget of words by weight; a source's target stops at a multiple
of its size and the excess is shared again by weight.  That is a water level t
with target = min(weight * t, cap), found exactly from prefix sums over the
source totals (one row per source).

A source with target / size = r takes every document floor(r) times and a
balanced sample of its documents once more.  The inclusion probability of that
sample, r - floor(r), moves through the null space of two constraints, words and
documents, three documents at a time, until each is 0 or 1.  Blocks of BLOCK
documents do so in parallel and leave two undecided documents each at most; the
rest meet again in fewer blocks, round after round, so a source's last block is
small whatever its size.  Its last LANDED documents don't fly; with the two left over
they are landed on the nearest totals, by trying all ways.

Edge cases: null text has size 0 and is never taken for words; null source is a
source of its own and comes last; repeated rows are units of their own; an
empty table or one without words gives targets of 0; other columns stay out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, word_count

BLOCK, LANDED, EPS = 4096, 10, 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: src (rank), source, n_docs, source_size, target."""
    totals = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # windows without a key: over one row per source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy("ratio", "src")
    everything = Window.partitionBy()
    ranked = (
        totals.withColumn("src", F.row_number().over(order) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("t", (F.col("budget") - F.col("capped")) / F.col("open"))
        # the level is the first at which the sources from here on stay below their caps
        .withColumn("level", F.min(F.when(F.col("t") <= F.col("ratio"), F.struct("ratio", "t"))).over(everything)["t"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("src", "source", "n_docs", "source_size", target.alias("target"))


def flight(size: list[float], p: list[float], seed: int, held: int = 0) -> list[int]:
    """Move p in place until no step keeps both totals; return what is still undecided, the last ``held`` documents with it."""
    draw = np.random.RandomState(seed).random_sample
    left: list[int] = []
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    kept = todo[len(todo) - held :] if held else []
    todo = todo[: len(todo) - len(kept)][::-1]
    rolls, at = draw(len(todo) + 1), 0
    while True:
        while len(left) < 3 and todo:
            left.append(todo.pop())
        if len(left) == 3:
            a, b, c = (size[i] for i in left)
            u = (b - c, c - a, a - b)
            if a == b == c:
                u = (1.0, -1.0, 0.0)
        elif len(left) == 2 and size[left[0]] == size[left[1]]:
            u = (1.0, -1.0)
        else:
            return left + kept
        up = min((((1 - p[i]) if d > 0 else p[i]) / abs(d)) for i, d in zip(left, u) if d)
        down = min(((p[i] if d > 0 else (1 - p[i])) / abs(d)) for i, d in zip(left, u) if d)
        if at == len(rolls):
            rolls, at = draw(1024), 0
        step = up if rolls[at] * (up + down) < down else -down
        at += 1
        for i, d in zip(left, u):
            p[i] += step * d
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        left = [i for i in left if 0 < p[i] < 1]


def land(size: list[float], p: list[float], left: list[int]) -> None:
    """Decide the last documents so that words (whole ones), then documents, come nearest; all ways are tried."""
    k, w = np.array([p[i] for i in left]), np.array([size[i] for i in left])
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words, docs = np.abs(ways @ w - k @ w), np.abs((ways - k).sum(axis=1))
    best = np.lexsort((words, docs, np.floor(words)))[0]
    for v, i in zip(ways[best].tolist(), left):
        p[i] = float(v)


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "size", "p"], kind="stable", na_position="last").reset_index(drop=True)
    size, p = pdf["size"].astype(float).tolist(), pdf["p"].tolist()
    last = pdf["blocks"][0] == 1
    left = flight(size, p, zlib.crc32(f"{pdf['src'][0]}/{pdf['block'][0]}/{pdf['turn'][0]}".encode()), LANDED if last else 0)
    if last:
        land(size, p, left)
    pdf["p"] = p
    return pdf


def cube_mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, size, ...) with src, source_size, target and ``times`` (0, 1 or 2)."""
    extra = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    targets = cut_lineage(targets)
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        sized.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "d.size", *(f"d.{c}" for c in extra), "t.src", "t.n_docs", "t.source_size", "t.target", r.alias("r"))
        .withColumn("base", F.floor(F.col("r") + F.lit(EPS)).cast("int"))
        .withColumn("p", F.greatest(F.col("r") - F.col("base"), F.lit(0.0)))
        .withColumn("turn", F.lit(0))
        .withColumn("block", F.lit(0).cast("long"))
        .withColumn("blocks", F.lit(0).cast("long"))
    )
    open_, done = F.col("p").between(EPS, 1 - EPS), []
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    done.append(units.filter(~open_))
    rest, turn, bound, n = units.filter(open_), 0, most, F.col("n_docs").cast("double")
    while bound:
        blocks = F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("long")
        rest = rest.withColumns({"turn": F.lit(turn), "blocks": blocks}).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(turn)), F.col("blocks")))
        rest = rest.groupBy("src", "block").applyInPandas(_block, rest.schema)
        if bound <= BLOCK:
            done.append(rest)
            break
        # a block leaves two undecided documents at most
        rest = cut_lineage(rest)
        done.append(rest.filter(~open_))
        rest, n, bound, turn = rest.filter(open_), 2 * blocks.cast("double"), 2 * -(-bound // BLOCK), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("times", F.col("base") + F.round("p").cast("int")).drop("r", "base", "p", "turn", "block", "blocks", "n_docs")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    sized = cut_lineage(sized)
    mixed = cube_mix(sized, source_targets(sized, weights, share, most))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times")
