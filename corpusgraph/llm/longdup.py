"""Removal of repeated byte strings by blockwise suffix sorting.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else.
Suffix buckets come from the content: all windows of SPAN bytes whose smallest
gram is the same are one bucket (``windows``), so equal windows always meet.

1. One pass over the texts gives runs of windows (bucket h, a hash of the run's
   bytes), kept as arrays.  Counting (h, hash), summed up in the tasks before one
   shuffle by h, finds buckets with two or more runs; all other windows are unique.
   The hash serves for counting only, what is equal is told by bytes.
2. The bytes of the runs of these buckets go there, what a batch holds twice once.
   Buckets are dealt over tasks and taken a block at a time, memory bounded by BLOCK
   bytes of text: equal runs fall together, different ones of one bucket are sorted by
   suffixes with a difference cover (``suffixes``).
3. A bucket with more than LARGE different runs, the same gram in many surroundings, is
   split: its runs are cut where the smallest gram under two other orders changes, and
   go to the buckets of all three grams.  Equal windows still meet.
4. Spans go back to their documents; the remaining bytes are hashed.

Document texts are shuffled once, by document; that exchange serves steps 2 and 4.

Edge cases: null text is empty; texts shorter than SPAN stay whole; repeated rows
and copies count as occurrences of one another; matches never cross documents;
a text of one repeated byte gives one run per byte, counted like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, ranges, slices, utf8
from .suffixes import repeated_windows
from .windows import GRAM, SPAN, grams, runs, sliding_argmin

LARGE, BLOCK, STEP, FLUSH = 4096, 2 << 20, 1 << 20, 200_000
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


NO_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (a stand-in where it is null, so that joins keep one partitioning), hash of the text, text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def _runs_of(b: pa.RecordBatch, span: int) -> tuple[np.ndarray, ...]:
    """Row, h, hash of the bytes, first and last window of each run in a batch of (doc_id, th, text)."""
    data, off = utf8(b.column(2))
    doc, first, last, _, h = runs(data, off, span)
    raw = memoryview(np.ascontiguousarray(data))
    ch = np.array([int.from_bytes(hashlib.blake2b(raw[x : y + span], digest_size=8).digest(), "little", signed=True) for x, y in zip(first.tolist(), last.tolist())], np.int64)
    return doc, h.view(np.int64), ch, first - off[doc], last - off[doc]


def packed_runs(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, th and the runs of windows of each text that has any, as arrays h, ch, first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            doc, h, ch, first, last = _runs_of(b, span)
            count = np.bincount(doc, minlength=b.num_rows)
            ends = pa.array(np.r_[0, np.cumsum(count[count > 0])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h, ch, first.astype(np.int32), last.astype(np.int32))]
            some = pa.array(np.flatnonzero(count).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), *lists], ["doc_id", "th", "h", "ch", "first", "last"])

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, h array<long>, ch array<long>, first array<int>, last array<int>")


def run_rows(packed: DataFrame) -> DataFrame:
    """doc_id, th, h, first, last of every run of windows."""
    return packed.select("doc_id", "th", F.explode(F.arrays_zip("h", "first", "last")).alias("r")).select("doc_id", "th", "r.*")


def run_counts(packed: DataFrame) -> DataFrame:
    """h, ch, n, summed up over FLUSH runs at a time."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, ch = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ch, h))
        h, ch = h[order], ch[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (ch[1:] != ch[:-1])]) if len(h) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(ch[first]), pa.array(np.diff(np.r_[first, len(h)]).astype(np.int64))], ["h", "ch", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield summed(held)
                held = []
        if held:
            yield summed(held)

    return packed.select("h", "ch").mapInArrow(run, "h long, ch long, n long")


_SENT = "h long, doc_id long, th long, first int, last int, many boolean, bytes binary"


def split_runs(data: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Runs (flat places) cut where the smallest gram of a window under either of two other orders changes: run, key, first, last."""
    g = grams(data)
    number = last - first + 1
    at, run = ranges(first, number), np.repeat(np.arange(len(first)), number)
    picks = [sliding_argmin(mix64(g ^ other), span - GRAM + 1)[at] for other in (_B1, _B2)]
    new = np.r_[True, (run[1:] != run[:-1]) | (picks[0][1:] != picks[0][:-1]) | (picks[1][1:] != picks[1][:-1])]
    with np.errstate(over="ignore"):
        key = mix64(g[picks[0][new]] * _B1 + g[picks[1][new]] * _B2 + h[run[new]].view(np.uint64))
    return run[new], key.view(np.int64), at[new], at[np.r_[new[1:], True]]


def _contexts(rows: DataFrame, span: int) -> DataFrame:
    """Bytes of the runs named in ``want``, each string of a batch once; bytes is null for runs that are known to repeat."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            data, off = utf8(b.column(2))
            want = b.column(3)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(want).to_numpy(zero_copy_only=False))
            h, hot, first, last = (want.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(h):
                continue
            first, last = first + off[row], last + off[row]
            if hot.any():
                own, key, f, z = split_runs(data, h[hot], first[hot], last[hot], span)
                h, first, last, row = np.r_[h[~hot], key], np.r_[first[~hot], f], np.r_[last[~hot], z], np.r_[row[~hot], row[hot][own]]
            size = last - first + span
            strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(np.r_[0, np.cumsum(size)]), pa.py_buffer(data[ranges(first, size)])])
            code = strings.dictionary_encode().indices.to_numpy()
            _, lead, n = np.unique(code, return_index=True, return_counts=True)
            other = np.ones(len(h), bool)
            other[lead] = False
            known = np.flatnonzero(other)
            take = np.r_[lead, known]
            ids, th = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
            route = np.r_[h[lead], mix64(ids[known].view(np.uint64)).view(np.int64)]
            raw = pa.concat_arrays([strings.take(pa.array(lead)).cast(pa.binary()), pa.nulls(len(known), pa.binary())])
            place = [pa.array((x - off[row])[take].astype(np.int32)) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(ids[take]), pa.array(th[take]), *place, pa.array(np.r_[n > 1, np.ones(len(known), bool)]), raw], ["h", "doc_id", "th", "first", "last", "many", "bytes"])

    return rows.mapInArrow(cut, _SENT)


def _spans(flags: np.ndarray, row: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and byte spans covered by flagged windows that follow one another."""
    k = np.flatnonzero(flags)
    if not len(k):
        return k, k, k
    new = np.r_[True, (k[1:] != k[:-1] + 1) | (row[k[1:]] != row[k[:-1]])]
    a, b = k[new], k[np.r_[new[1:], True]]
    return row[a], start[a], start[b] + span


def repeats_of(t: pa.Table, span: int) -> pa.RecordBatch:
    """Spans of a block of whole buckets that occur twice: runs that are equal, and windows of different runs of one bucket."""
    known = t.filter(pc.is_null(t.column("bytes")))
    out = [tuple(np.asarray(known.column(c)) + more for c, more in (("doc_id", 0), ("th", 0), ("first", 0), ("last", span)))]
    t = t.filter(pc.is_valid(t.column("bytes")))
    ids, th, first, last, many = (np.asarray(t.column(c)) for c in ("doc_id", "th", "first", "last", "many"))
    raw = t.column("bytes").combine_chunks().cast(pa.large_binary())
    code = raw.dictionary_encode().indices.to_numpy()
    _, lead, of, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    twice = (n > 1) | (np.bincount(of, many, len(lead)) > 0)
    k = np.flatnonzero(twice[of])
    out.append((ids[k], th[k], first[k], last[k] + span))
    bucket = np.unique(np.asarray(t.column("h")), return_inverse=True)[1]
    one = np.sort(lead)
    one = one[np.bincount(bucket[one], minlength=1)[bucket[one]] > 1] if len(one) else one
    if len(one):
        text, off = utf8(raw.take(pa.array(one)))
        size = np.diff(off)
        windows = size - span + 1
        at, row = ranges(off[:-1], windows), np.repeat(np.arange(len(size)), windows)
        flags = repeated_windows(text, np.repeat(bucket[one], size), at, span)
        own, a, z = _spans(flags, row, at - off[row] + first[one[row]], span)
        alone = ~twice[of[one[own]]]  # the others go as a whole
        own = one[own[alone]]
        out.append((ids[own], th[own], a[alone], z[alone]))
    cols = [np.concatenate(x) for x in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(cols, (np.int64, np.int64, np.int32, np.int32))], ["doc_id", "th", "a", "b"])


def sort_buckets(rows: DataFrame, span: int) -> DataFrame:
    """Spans of windows that repeat within their bucket; rows as ``_contexts`` gives them."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return repeats_of(pa.Table.from_batches(parts).combine_chunks(), span)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            # whole buckets only: what follows the last change of h waits
            held.append(b)
            size += b.nbytes
            if size < BLOCK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            h = np.asarray(t.column("h"))
            ends = np.flatnonzero(h[1:] != h[:-1]) + 1
            if not len(ends):
                continue
            mean, done = max(1, size // len(h)), 0
            while len(h) - done > 1 and (size := mean * (len(h) - done)) >= BLOCK:
                to = ends[(ends > done) & (ends <= done + max(1, BLOCK // mean))]
                to = int(to[-1]) if len(to) else next((int(e) for e in ends if e > done), 0)
                if not to:
                    break
                yield block(t.slice(done, to - done).to_batches())
                done = to
            rest = t.slice(done)
            held, size = rest.to_batches(), mean * rest.num_rows
        if held:
            yield block(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(sort, "doc_id long, th long, a int, b int")


def wanted_runs(docs: DataFrame, span: int = SPAN, large: int = LARGE) -> DataFrame:
    """doc_id, th, want: the runs of each document whose bucket has others (h, whether it is to be split, first, last)."""
    # tasks have summed up what repeats, so one partition by h holds few rows of a frequent run
    packed = cut_lineage(packed_runs(docs, span))
    counted = run_counts(packed).repartition("h").groupBy("h", "ch").agg(F.sum("n").alias("n"))
    buckets = counted.groupBy("h").agg(F.count("*").alias("different"), F.sum("n").alias("n_h")).filter("n_h > 1").select("h", (F.col("different") > large).alias("hot"))
    buckets = cut_lineage(buckets)  # so that both sides of the join are dealt for it, and a frequent h can be split
    return run_rows(packed).join(buckets, "h").groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "hot", "first", "last")).alias("want"))


def remove_repeats(docs: DataFrame, span: int = SPAN, large: int = LARGE, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept: the remaining bytes] of every row."""
    key = ["doc_id", "th"]
    texts = _keyed(docs).repartition(*key)
    cut = _contexts(texts.join(wanted_runs(docs, span, large), key).select(*key, "text", "want"), span)
    found = sort_buckets(cut, span).groupBy(*key).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    rows = texts.join(found, key, "left").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", F.coalesce("spans", none).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 * STEP):
            out: list[list] = [[] for _ in range(5 + with_text)]
            for d, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode("utf-8")
                runs_, kept, end = 0, [], 0
                for m in sorted(marks or (), key=lambda m: (m["a"], m["b"])):
                    if m["a"] > end or not runs_:
                        runs_ += 1
                        kept.append(raw[end : m["a"]])
                    end = max(end, m["b"])
                kept.append(raw[end:])
                left = b"".join(kept)
                for o, v in zip(out, (d, len(raw), len(raw) - len(left), runs_, hashlib.sha256(left).hexdigest(), left)):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return rows.mapInArrow(cut, schema)
