"""Quality rules with a hashed n-gram classifier.

Base rules count words, symbols, repeated lines and repeated three-word windows
of a whole text.  A logistic regression over hashed word n-grams (1 and 2 words)
and character n-grams (2 to 4 bytes of UTF-8) is trained on a bounded sample of
labelled rows; a Platt curve fitted on held-out labelled rows turns its score
into a probability, which fixed thresholds judge.

Training: SAMPLE labelled rows at most, chosen by a hash of doc_id, features of
their whole texts; a quarter of them is held out for the calibration.  Scoring: one pass
in Arrow batches.  A feature is the share of a text's n-grams that fall into a
bin, so a score is a mean of gathered weights and needs no per-row Python.

Edge cases: null or empty text has no words and fails the base rules; labels
that are null, or whose document is missing, are left out; repeated labels count
as rows; without labels of both kinds there is no model and the base rules alone
decide; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, utf8

SAMPLE, BINS, ORDERS = 1500, 1 << 12, (2, 3, 4)
FAMILIES = 2 + len(ORDERS)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = re.compile(r"[#*$%&|<>]")
STEP = 1 << 20  # bytes of text held in numpy at once


def _bin(h: np.ndarray) -> np.ndarray:
    return (mix64(h) >> np.uint64(64 - 12)).astype(np.int32)


def hashed_ngrams(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the bins of all its n-grams, in text order, and the document of each."""
    n, rows, out = len(data), len(off) - 1, []
    doc = np.repeat(np.arange(rows), np.diff(off))
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        word = ~SPACE[data] if n else np.zeros(0, bool)
        same = doc[1:] == doc[:-1]
        starts = np.flatnonzero(word & np.r_[True, ~word[:-1] | ~same]) if n else np.zeros(0, int)
        ends = np.flatnonzero(word & np.r_[~word[1:] | ~same, True]) + 1 if n else np.zeros(0, int)
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, base)])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)))])
        total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])]
        h = mix64((total[ends] - total[starts]) * inverse[starts])
        at = doc[starts] if n else np.zeros(0, int)
        out.append((_bin(h), at))
        pair = at[1:] == at[:-1]
        out.append((_bin((h[:-1] * np.uint64(31) + h[1:])[pair]), at[1:][pair]))
        x = data.astype(np.uint64)
        for k in ORDERS:
            g = np.uint64(k)
            for j in range(k):
                g = (g << np.uint64(8)) | x[j : n - k + 1 + j] if n >= k else np.zeros(0, np.uint64)
            ok = doc[k - 1 :] == doc[: n - k + 1] if n >= k else np.zeros(0, bool)
            out.append((_bin(g[ok]), doc[k - 1 :][ok]))
    return out


def shares(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x (families * BINS) of the shares, for training."""
    rows = len(off) - 1
    parts = []
    for bins, doc in hashed_ngrams(data, off):
        count = np.bincount(doc * BINS + bins, minlength=rows * BINS).reshape(rows, BINS)
        parts.append((count / np.maximum(1, count.sum(1, keepdims=True))).astype(np.float32))
    return np.concatenate(parts, 1)


@dataclass
class Model:
    weights: np.ndarray  # families * BINS
    bias: float
    slope: float
    shift: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Calibrated probability that a text is good."""
        rows = len(off) - 1
        z = np.full(rows, self.bias)
        for f, (bins, doc) in enumerate(hashed_ngrams(data, off)):
            n = np.bincount(doc, minlength=rows)
            z += np.bincount(doc, self.weights[f * BINS + bins], rows) / np.maximum(1, n)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the penalised log loss; classes weigh the same."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        e = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - y)
        g, gb = e @ x + penalty * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's curve: Newton steps, halved until the loss falls.

    Platt's targets, inside 0 and 1, keep the curve finite on separable rows.
    """
    pos, neg = int((y == 1).sum()), int((y != 1).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    unit = float(np.abs(z).mean()) or 1.0
    z = z / unit
    loss = lambda a, c: float((np.logaddexp(0, a * z + c) - t * (a * z + c)).sum())
    a, c = 0.0, float(np.log((pos + 1) / (neg + 1)))
    now = loss(a, c)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -500, 500)))
        r, q = p - t, p * (1 - p)
        g = np.array([(r * z).sum(), r.sum()])
        if np.abs(g).max() < 1e-6:
            break
        hess = np.array([[(q * z * z).sum() + 1e-9, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-9]])
        da, dc = np.linalg.solve(hess, g)
        step = 1.0
        while step > 1e-9 and (new := loss(a - step * da, c - step * dc)) >= now - 1e-4 * step * float(g @ (da, dc)):
            step /= 2
        if step <= 1e-9:
            break
        a, c, now = a - step * da, c - step * dc, new
    return a / unit, c


def fit(x: np.ndarray, y: np.ndarray, trained: int, penalty: float = 1e-3) -> Model | None:
    """A model of the first ``trained`` rows, calibrated on the rest; x is scaled in place, as it is the driver's largest array."""
    if len(set(y[:trained])) < 2:
        return None
    scale = np.sqrt(np.einsum("ij,ij->j", x[:trained], x[:trained]) / trained) + 1e-4
    x /= scale
    w, b = _logistic(x[:trained], y[:trained].astype(np.float32), penalty)
    z = x[trained:] @ w + b
    a, c = calibrate(z, y[trained:]) if len(set(y[trained:])) == 2 else (1.0, 0.0)
    return Model((w / scale).astype(np.float32), b, float(a), float(c))


def train_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    rows = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "label_id", "y")
        .limit(sample)
    )
    # the sample has a fixed number of rows; of texts that share a doc_id the first by order counts
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                x = shares(*utf8(s.column(3)))
                cells = [np.flatnonzero(r).astype(np.int32) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).cast(pa.int64()), s.column(1).cast(pa.int32()), s.column(2), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([r[c].tobytes() for r, c in zip(x, cells)], pa.binary())],
                    ["doc_id", "y", "h", "at", "x"],
                )

    # every fourth row by hash is held out for the calibration and comes last
    got = sorted(texts.mapInArrow(features, "doc_id long, y int, h long, at binary, x binary").collect(), key=lambda r: (r["h"] % 4 == 0, r["h"], r["doc_id"], r["y"], r["at"]))
    x = np.zeros((len(got), FAMILIES * BINS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["x"], np.float32)
    y, trained = np.array([r["y"] for r in got], np.int64), sum(r["h"] % 4 != 0 for r in got)
    del got
    return fit(x, y, trained)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n + 2)
    v = np.int64(len(ids))
    _, pairs = np.unique(a[:-1] * v + a[1:], return_inverse=True)
    _, inverse, counts = np.unique(pairs[:-1] * v + a[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(n + 3, np.int32)
    again = counts[inverse] > 1
    hit[:n][again] += 1
    hit[3 : n + 3][again] -= 1
    return int((np.cumsum(hit) > 0).sum())


def base_facts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8")
    words = raw.split()  # bytes split on exactly the six blanks
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words)


FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_documents(docs: DataFrame, model: Model | None, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50, prefix: str = "q_") -> DataFrame:
    """All columns of ``docs`` and, with ``prefix`` before their names, the facts, base_failed, prob, kept."""
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, *(StructField(prefix + n, LongType()) for n in FACTS), StructField(f"{prefix}base_failed", BooleanType()), StructField(f"{prefix}prob", DoubleType()), StructField(f"{prefix}kept", BooleanType())])
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            text = b.column(k)
            facts = np.array([base_facts(t or "") for t in text.to_pylist()], np.int64).reshape(-1, len(FACTS))
            failed = (facts[:, 0] < min_words) | (100 * facts[:, 4] > max_repeat * facts[:, 0])
            prob = np.ones(b.num_rows) if model is None else model.score(*utf8(text))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(facts[:, i]) for i in range(len(FACTS))), pa.array(failed), pa.array(prob), pa.array(~failed & (prob >= threshold))],
                names=schema.fieldNames(),
            )

    return docs.mapInArrow(run, schema)


def rate_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rated = judge_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_model(docs, labels))
    return rated.select("doc_id", *(F.col(f"q_{n}").alias(n) for n in FACTS), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_prob").alias("quality_prob"))
