"""Hard negatives by rotated one-bit codes with certain bounds.

A vector o is turned by one random rotation and kept as the signs of its components:
with x = signs / sqrt(d), a unit vector, o = <o,x> x + rest.  Stored beside the code
are the alignment <o,x> and the length of the rest.  For a query q, turned alike,

    <q,o> = <q,x> <o,x> + <q - <q,x> x, rest>

and by Cauchy and Schwarz the second term is at most |q - <q,x> x| |rest|.  <q,x> comes
from popcounts of the code against the BITS bit planes of q, whose rounding error has
a bound as well.  So each pair has an interval that holds its inner product for
certain, and only pairs whose interval may enter a result are scored by integers.

1. ``encode`` turns the vectors into integers (floor(scale x)), codes and bounds, once.
2. Anchors, a stated set of queries, meet all rows in blocks (ANCHORS x ROWS).  In
   each block an anchor's intervals are told from the popcounts; a threshold comes
   from the integer scores of the most promising rows, and what can't pass it is
   ruled out.  A block returns a few rows an anchor, the best of all blocks are merged.
3. The same with the positives known: for each (anchor, positive) the band of scores
   that a negative may have.

Rows are dealt to blocks by a hash of all they hold.  Each row is sent once for every
ANCHORS anchors, so memory is bounded by the blocks and nothing is broadcast.

Edge cases: a null label, id or vector, and null or non-finite components, take no
part; nor do components of 2**26 or more after scaling, whose products need not fit a
long; equal rows count once; rows of one vec_id with different vectors are different
rows, never positives of one another; vectors of other lengths than the anchor's, and
empty ones, aren't compared; labels are compared after ``relabel``; ties go to the
smaller vec_id (then label and vector, so that reruns agree); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

SCALE, BITS, SEED = 256, 6, 20
ANCHORS, ROWS, ONCE = 4096, 16384, 1 << 20
LARGEST = 1 << 26


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(rows: DataFrame) -> DataFrame:
    """vec_id, label, d, ints, code, align, rest of rows (vec_id, label, embedding) that take part, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = np.asarray(b.column("d"))
            for d in np.unique(length).tolist():
                part = b.filter(pa.array(length == d))
                ints = part.column("ints").flatten().to_numpy().reshape(-1, d)
                turned = ints @ rotation(d)
                code = np.packbits(turned > 0, axis=1)
                code = np.pad(code, ((0, 0), (0, -code.shape[1] % 8)))
                align = np.abs(turned).sum(axis=1) / np.sqrt(d)
                rest = np.sqrt(np.maximum((turned * turned).sum(axis=1) - align * align, 0))
                kept = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (ints.astype("<i4"), code)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("d"), *kept, pa.array(align), pa.array(rest)], ["vec_id", "label", "d", "ints", "code", "align", "rest"])

    whole = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & fit
    rows = rows.filter(F.coalesce(part, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("d"), whole.cast("array<long>").alias("ints"))
    return rows.distinct().mapInArrow(run, "vec_id long, label long, d int, ints binary, code binary, align double, rest double")


class Block:
    """Rows of one length as arrays."""

    def __init__(self, t: pa.Table, d: int) -> None:
        self.d = d
        self.ids, self.label = np.asarray(t.column("vec_id")), np.asarray(t.column("label"))
        self.raw = t.column("ints").to_pylist()
        self.ints = np.frombuffer(b"".join(self.raw), "<i4").reshape(-1, d).astype(np.int64)
        self.code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(len(self.ids), -1)
        self.align, self.rest = np.asarray(t.column("align")), np.asarray(t.column("rest"))
        self.doubled = len(np.unique(self.ids)) < len(self.ids)
        # whole numbers below 2**53 are exact as doubles, whose products are much faster
        most = int(np.abs(self.ints).max(initial=1))
        self.exact = self.ints.astype(float) if most * most * d < 1 << 53 else self.ints
        self.most = most


class Scores:
    """Integer scores of a block's rows with one query, each computed when it is first asked for."""

    def __init__(self, rows: Block, q: np.ndarray):
        fits = rows.exact.dtype == float and int(np.abs(q).max(initial=1)) * rows.most * rows.d < 1 << 53
        self.rows, self.q = rows.exact if fits else rows.ints, q.astype(float) if fits else q
        self.known, self.value = np.zeros(len(rows.ids), bool), np.zeros(len(rows.ids), np.int64)

    def of(self, at: np.ndarray) -> np.ndarray:
        new = at[~self.known[at]]
        if len(new):
            self.value[new] = (self.rows[new] @ self.q).astype(np.int64)
            self.known[new] = True
        return self.value[at]


def intervals(q: np.ndarray, rows: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Certain lower and upper bounds of the inner products of integer queries with the rows of a block."""
    d = rows.d
    turned = q @ rotation(d)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << bits) - 1), 1e-12)
    level = np.rint((turned - low) / step).astype(np.int64)
    off = np.abs(turned - (low + step * level)).sum(axis=1, keepdims=True) / np.sqrt(d)
    ones = np.bitwise_count(rows.code).sum(axis=1, dtype=np.int64)
    hits = np.zeros((len(q), len(rows.ids)), np.int64)  # sum of the levels where the code has a one
    for k in range(bits):
        plane = np.packbits((level >> k) & 1 > 0, axis=1)
        plane = np.ascontiguousarray(np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8)))).view(np.uint64)
        for w in range(plane.shape[1]):
            hits += np.bitwise_count(plane[:, w, None] & rows.code[None, :, w]).astype(np.int64) << k
    along = (low * (2 * ones - d) + step * (2 * hits - level.sum(axis=1, keepdims=True))) / np.sqrt(d)
    length = (turned * turned).sum(axis=1, keepdims=True)
    aside = np.sqrt(np.maximum(length - np.maximum(np.abs(along) - off, 0) ** 2, 0))
    mid = along * rows.align
    size = np.sqrt(length) * np.sqrt(rows.align**2 + rows.rest**2)
    far = off * rows.align + aside * rows.rest + 1e-9 * size + 1e-6
    return mid - far, mid + far


def best(ids: np.ndarray, score: np.ndarray, ties: list[tuple], k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id, then by what else a row holds."""
    order = np.lexsort((ids, -score))[: k + 1]
    if len(order) > 1 and len(np.unique(ids)) < len(ids):
        order = np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i], *ties[i])))
    return order[:k]


def _pick(scores: Scores, low: np.ndarray, high: np.ndarray, able: np.ndarray, rows: Block, bottom: float, top: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best rows among ``able`` whose score lies in [bottom, top]; how many were scored."""
    at = np.flatnonzero(able & (high >= bottom) & (low <= top))
    if not len(at):
        return at, at, 0
    # what is promising by its interval is scored first, its k-th score is a threshold for the rest
    first = at if len(at) <= 4 * k else at[np.argpartition(-np.minimum(high[at], top), 4 * k)[: 4 * k]]
    score = scores.of(first)
    inside = np.sort(score[(score >= bottom) & (score <= top)])
    if len(first) < len(at):
        if len(inside) >= k:
            at = at[high[at] >= inside[-k]]
        score = scores.of(at)
    else:
        at = first
    ok = (score >= bottom) & (score <= top)
    count, at, score = len(at), at[ok], score[ok]
    order = best(rows.ids[at], score, [(int(rows.label[i]), rows.raw[i]) for i in at] if rows.doubled else [], k)
    return at[order], score[order], count


def _in_blocks(coded: DataFrame, anchors: DataFrame, blocks: tuple[int, int], run, schema: str) -> DataFrame:
    """``run`` on each pair of a block of anchors and a block of rows of one length."""
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "label", "ints"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"ab": deal(blocks[0])}).withColumn("rb", every(blocks[1]))
    right = coded.select(*(F.col(c).alias(c) for c in coded.columns), deal(blocks[1]).alias("rb")).withColumn("ab", every(blocks[0]))
    key = ["d", "ab", "rb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


_TOLD = "anchor_id long, anchor_key binary, label long, id long, positive_label long, positive_key binary, score long, scored long"


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            d = left.column("d")[0].as_py()
            q, rows = Block(left, d), Block(right, d)
            for at in range(0, len(q.ids), step := max(1, ONCE // len(rows.ids))):
                part = slice(at, at + step)
                low, high = intervals(q.ints[part].astype(float), rows)
                for i in range(len(low)):
                    a = at + i
                    found, score, n = _pick(Scores(rows, q.ints[a]), low[i], high[i], (rows.label == q.label[a]) & (rows.ids != q.ids[a]), rows, -np.inf, np.inf, k)
                    out += [(int(q.ids[a]), q.raw[a], int(q.label[a]), int(rows.ids[j]), int(rows.label[j]), rows.raw[j], int(s), n) for j, s in zip(found, score)]
        return _table(out, _TOLD)

    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


_FOUND = "anchor_id long, anchor_key binary, label long, positive_id long, positive_key binary, positive_score long, id long, negative_label long, negative_key binary, score long, scored long"


def _negatives(k: int, least: int, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            d = left.column("d")[0].as_py()
            q, rows, known = Block(left, d), Block(right, d), left.column("positives").to_pylist()
            for at in range(0, len(q.ids), step := max(1, ONCE // len(rows.ids))):
                low, high = intervals(q.ints[at : at + step].astype(float), rows)
                for i in range(len(low)):
                    a = at + i
                    scores, other = Scores(rows, q.ints[a]), rows.label != q.label[a]
                    for p in known[a]:
                        bottom, top = -(-least * p["score"] // 100), most * p["score"] // 100
                        found, score, n = _pick(scores, low[i], high[i], other, rows, bottom, top, k) if bottom <= top else ((), (), 0)
                        out += [(int(q.ids[a]), q.raw[a], int(q.label[a]), p["id"], p["positive_key"], p["score"], int(rows.ids[j]), int(rows.label[j]), rows.raw[j], int(s), n) for j, s in zip(found, score)]
        return _table(out, _FOUND)

    return run


def _first(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, anchors_a_block: int = ANCHORS, rows_a_block: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id.
    A negative has another label and between ``least`` and ``most`` per cent of the
    positive's score; the ``negatives`` highest of each (anchor, positive) are returned.
    """
    coded = cut_lineage(encode(rows))
    anchors = coded.filter(is_anchor)
    blocks = (-(-anchors.count() // anchors_a_block) or 1, -(-coded.count() // rows_a_block) or 1)
    own = ["anchor_id", "label", "anchor_key"]
    near = _in_blocks(coded, anchors, blocks, _positives(positives), _TOLD)
    near = _first(near, own, [F.desc("score"), F.asc("id"), F.asc("positive_label"), F.asc("positive_key")], positives)
    known = near.groupBy(*own).agg(F.collect_list(F.struct("id", "positive_key", "score")).alias("positives"))  # ``positives`` at most
    asked = anchors.join(known.withColumnsRenamed({"anchor_id": "vec_id", "anchor_key": "ints"}), ["vec_id", "label", "ints"])
    asked = cut_lineage(asked.select(*coded.columns, "positives"))
    far = _in_blocks(coded, asked, blocks, _negatives(negatives, least, most), _FOUND)
    far = _first(far, [*own, "positive_id", "positive_key"], [F.desc("score"), F.asc("id"), F.asc("negative_label"), F.asc("negative_key")], negatives)
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabel(rows: DataFrame) -> DataFrame:
    """Every seventh vector gets the next of ten labels: a known share of labels that are off."""
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).alias("label"), "embedding")


def oracle() -> str:
    return """
WITH ok AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM ok WHERE vec_id % 100 = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.label, o.vec_id AS id, o.label AS other, list_sum(list_transform(list_zip(a.v, o.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM a JOIN ok o ON o.vec_id <> a.vec_id AND len(o.v) = len(a.v)),
pos AS (SELECT * FROM pairs WHERE label = other QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank
  FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.other <> n.label AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""
