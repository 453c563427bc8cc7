"""Removal of repeated word windows by super-k-mer partitioning.

A word goes if a window of WIDTH words that covers it also starts earlier: in a
document of smaller doc_id, or further to the front of the same one.

Consecutive windows that share a minimiser (the smallest hash of GRAM words in
them, the rightmost of equals) form a super-k-mer.  Equal windows have the same
minimiser at the same place, so they meet in its bucket.

1. Minimisers are counted.  One that occurs once has no repeated window: two windows
   of one super-k-mer differ in where the minimiser stands.  Others are told to the
   documents that hold them.
2. Their super-k-mers travel to the bucket of the minimiser, each as one packed string
   of its words.  Strings that a batch holds twice are sent once, by their first owner,
   the others are known to repeat.
3. Buckets are sorted a block of BLOCK bytes at a time: equal strings fall together,
   windows of different strings are ranked by doubling (1, 2, 4, ... words), on
   ids of the words' bytes, so hashes never decide what is equal.
4. A hot minimiser has the same words in many different surroundings: over LARGE super-
   k-mers (and over a millionth of all, so that the list of them has a bound) that
   differ within FLUSH of a task.  Its super-k-mers are cut down to single windows,
   whose bucket is the hash of all their words, and go the same way.
5. Late spans go back to their documents, whose texts are shuffled once for 2 and 5.

Edge cases: null and empty texts, and texts of fewer than WIDTH words, stay whole;
rows that share doc_id and text are one document twice (equal places, neither is
earlier); rows of one doc_id with different texts count as one document by place, so
of windows at the same place neither goes; a null doc_id sorts before all others;
other columns are ignored.  A row is never cut: a task needs some 60 bytes for each
byte of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, mix64, ranges, slices, utf8
from .tokens import bounds, hashes, joined
from .windows import sliding_argmin

WIDTH, GRAM = 20, 5
LARGE, MOST_HOT = 8192, 1_000_000
STEP, BLOCK, FLUSH = 2 << 20, 2 << 20, 2_000_000
NO_ID = -(1 << 63)
_SENT = "h long, doc_id long, key long, first int, last int, words binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (a stand-in where it is null), a hash of id and text by which parts of a document meet again, text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def super_kmers(word: np.ndarray, doc: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Minimiser, hash of all words, first and last window start (flat word places) of each super-k-mer."""
    n, none = len(word), np.zeros(0, np.int64)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none
    with np.errstate(over="ignore"):
        h, factor = word[: n - gram + 1].copy(), np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(1, gram):
            h = h * factor + word[k : n - gram + 1 + k]
        h = mix64(h)
    pick = sliding_argmin(h, width - gram + 1)[: n - width + 1]
    whole = doc[: n - width + 1] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none
    new = np.r_[True, (pick[at[1:]] != pick[at[:-1]]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]
    first, last = at[new], at[np.r_[new[1:], True]]
    return h[pick[first]], span_hashes(word, first, last + width), first, last


def span_hashes(word: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from each ``first`` to before ``end``."""
    with np.errstate(over="ignore"):
        base = 0x9E3779B97F4A7C15
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(word), np.uint64(base))])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(word), np.uint64(pow(base, -1, 1 << 64)))])
        total = np.r_[np.uint64(0), np.cumsum(word * power[:-1])]
        return mix64((total[end] - total[first]) * back[first])


def _found(b: pa.RecordBatch, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Bytes, start, end, hash and text of each word, then the super-k-mers of a batch of (doc_id, key, text)."""
    data, off = utf8(b.column(2))
    start, end, doc = bounds(data, off)
    word = hashes(data, start, end)
    return data, start, end, word, doc, *super_kmers(word, doc, width, gram)


def _minimisers(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """key, h of every super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            *_, doc, h, _, first, _ = _found(b, width, gram)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(doc[first])), pa.array(h.view(np.int64))], ["key", "h"])

    return _keyed(docs).mapInArrow(run, "key long, h long")


def _met(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """h, n (occurrences), different (strings, told apart within FLUSH of a task) of every minimiser."""

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        h, ch = np.concatenate(held, axis=1)
        order = np.lexsort((ch, h))
        h, ch = h[order], ch[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        new = np.r_[True, (h[1:] != h[:-1]) | (ch[1:] != ch[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(h)])), pa.array(np.add.reduceat(new.astype(np.int64), first))], ["h", "n", "different"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, "text", STEP):
            *_, h, ch, _, _ = _found(b, width, gram)
            held.append(np.stack([h, ch]))
            size += len(h)
            if size >= FLUSH:
                yield summed(held)
                held, size = [], 0
        if size:
            yield summed(held)

    return _keyed(docs).mapInArrow(run, "h long, n long, different long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("different").alias("different"))


def _cut(rows: DataFrame, width: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Packed strings of the super-k-mers of the minimisers in ``want``; words is null for spans that are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            data, start, end, word, doc, h, _, first, last = _found(b, width, gram)
            want, row = b.column(3), np.arange(b.num_rows, dtype=np.uint64)
            listed = np.repeat(row, pc.list_value_length(want).to_numpy(zero_copy_only=False))
            wanted = np.isin(mix64(h ^ mix64(row)[doc[first]]), mix64(want.flatten().to_numpy().view(np.uint64) ^ mix64(listed)))  # never one too few
            h, first, last = h[wanted], first[wanted], last[wanted]
            if not len(h):
                continue
            if len(hot) and (many := hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h).any():
                single = ranges(first[many], last[many] - first[many] + 1)
                h = np.r_[h[~many], span_hashes(word, single, single + width)]
                first, last = np.r_[first[~many], single], np.r_[last[~many], single]
            flat, at = joined(data, start, end)
            row = doc[first]
            base = np.searchsorted(doc, row)
            a, z = at[first], at[last + width] - 1
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(np.r_[0, np.cumsum(z - a)]), pa.py_buffer(flat[ranges(a, z - a)])])
            code = packed.dictionary_encode().indices.to_numpy()
            ids, key = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
            first, last = first - base, last - base
            send, known = first_owners(code, ids, first)
            take = np.r_[send, known]
            words = pa.concat_arrays([packed.take(pa.array(send)).cast(pa.binary()), pa.nulls(len(known), pa.binary())])
            route = np.r_[h[send], mix64(ids[known].view(np.uint64))].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(ids[take]), pa.array(key[take]), pa.array(first[take].astype(np.int32)), pa.array(last[take].astype(np.int32)), words], ["h", "doc_id", "key", "first", "last", "words"])

    return rows.select("doc_id", "key", "text", "want").mapInArrow(run, _SENT)


def first_owners(code: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each code by (ids, place), and the rows that come after theirs."""
    order = np.lexsort((place, ids, code))
    new = np.r_[True, code[order][1:] != code[order][:-1]] if len(order) else np.zeros(0, bool)
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order[new], order[(ids[order] != ids[lead]) | (place[order] != place[lead])]


def window_ranks(word: np.ndarray, width: int) -> np.ndarray:
    """Equal numbers for equal sequences of ``width`` words, by doubling; places too near to the end get any."""

    def pairs(rank: np.ndarray, step: int) -> np.ndarray:
        right = np.r_[rank[step:], np.zeros(min(step, len(rank)), np.int64)]
        return np.unique(rank * (int(rank.max()) + 1) + right, return_inverse=True)[1]

    rank, reach = word.astype(np.int64), 1
    while len(rank) and reach < width:
        step = min(reach, width - reach)
        rank, reach = pairs(rank, step), reach + step
    return rank


def _block(t: pa.Table, width: int) -> pa.RecordBatch:
    """Spans of a block of whole buckets whose windows start earlier elsewhere."""
    known = t.filter(pc.is_null(t.column("words")))
    out = [tuple(np.asarray(known.column(c)) + more for c, more in (("doc_id", 0), ("key", 0), ("first", 0), ("last", width)))]
    t = t.filter(pc.is_valid(t.column("words")))
    ids, key, first, last, h = (np.asarray(t.column(c)) for c in ("doc_id", "key", "first", "last", "h"))
    packed = t.column("words").combine_chunks().cast(pa.large_binary())
    one, later = first_owners(packed.dictionary_encode().indices.to_numpy(), ids, first)
    out.append((ids[later], key[later], first[later], last[later] + width))
    # windows of different strings of one bucket, each string by its first owner
    one = np.sort(one)
    bucket = np.unique(h, return_inverse=True)[1]
    one = one[np.bincount(bucket[one])[bucket[one]] > 1] if len(one) else one
    if len(one):
        text, off = utf8(packed.take(pa.array(one)))
        start, end, row = bounds(text, off)
        size = end - start
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)]), pa.py_buffer(text[ranges(start, size)])])
        rank = window_ranks(words.dictionary_encode().indices.to_numpy(), width)
        at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
        own, place = one[row[at]], first[one[row[at]]] + at - np.searchsorted(row, row[at])
        late = np.zeros(len(at), bool)
        late[first_owners(rank[at], ids[own], place)[1]] = True
        k = np.flatnonzero(late)
        if len(k):  # one span for late windows that follow one another
            new = np.r_[True, (k[1:] != k[:-1] + 1) | (own[k[1:]] != own[k[:-1]])]
            a, z = k[new], k[np.r_[new[1:], True]]
            out.append((ids[own[a]], key[own[a]], place[a], place[z] + width))
    cols = [np.concatenate(x) for x in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(cols, (np.int64, np.int64, np.int32, np.int32))], ["doc_id", "key", "a", "b"])


def _sorted(rows: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """Late spans of all buckets; a block holds whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            for part in slices(iter([b]), "words", block):
                held.append(part)
                size += int(pc.sum(pc.binary_length(part.column(5))).as_py() or 0)
                if size < block:
                    continue
                t = pa.Table.from_batches(held)
                h = np.asarray(t.column("h"))
                whole = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
                if whole:
                    yield _block(t.slice(0, whole), width)
                    held = t.slice(whole).combine_chunks().to_batches()
                    size = sum(int(pc.sum(pc.binary_length(x.column(5))).as_py() or 0) for x in held)
        if held:
            yield _block(pa.Table.from_batches(held), width)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc_id long, key long, a int, b int")


def late_spans(docs: DataFrame, texts: DataFrame, width: int = WIDTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """key, spans (doc_id, a, b): the word spans of each document whose windows start earlier."""
    met = cut_lineage(_met(docs, width, gram).filter("n > 1"))
    most = max(large, (met.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = np.sort(np.array([r["h"] for r in met.filter(F.col("different") > most).select("h").collect()], np.int64).view(np.uint64))
    want = _minimisers(docs, width, gram).join(met.select("h"), "h").groupBy("key").agg(F.collect_set("h").alias("want"))
    late = _sorted(_cut(texts.join(want, "key"), width, gram, hot), width)
    return late.groupBy("key").agg(F.collect_set(F.struct("doc_id", "a", "b")).alias("spans"))


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, large: int = LARGE, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 [, kept: the other words joined by blanks] of every row."""
    if not 0 < gram <= width:
        raise ValueError("a minimiser has at least one word and no more than a window")
    texts = _keyed(docs).repartition("key")
    own = F.filter("spans", lambda s: s["doc_id"] == F.col("doc_id"))
    none = F.array().cast("array<struct<doc_id:long,a:int,b:int>>")
    rows = texts.join(late_spans(docs, texts, width, gram, large), "key", "left").select("doc_id", "text", F.coalesce(own, none).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            data, off = utf8(b.column(1))
            start, end, doc = bounds(data, off)
            base = np.searchsorted(doc, np.arange(b.num_rows + 1))
            spans = b.column(2)
            own = base[np.repeat(np.arange(b.num_rows), pc.list_value_length(spans).to_numpy(zero_copy_only=False))]
            a, z = (spans.flatten().field(k).to_numpy() + own for k in (1, 2))
            depth = np.zeros(len(start) + 1, np.int64)
            np.add.at(depth, a, 1)
            np.add.at(depth, z, -1)
            kept = np.cumsum(depth)[:-1] == 0
            flat, at = joined(data, start[kept], end[kept])
            stop = np.r_[0, np.cumsum(np.bincount(doc[kept], minlength=b.num_rows))]
            raw = memoryview(flat)
            left = [raw[x : max(x, y - 1)] for x, y in zip(at[stop[:-1]].tolist(), at[stop[1:]].tolist())]
            ids = b.column(0)
            cols = [pc.if_else(pc.equal(ids, NO_ID), None, ids), pa.array(np.diff(base)), pa.array(np.diff(base) - np.diff(stop)), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
            if with_text:
                cols.append(pa.array([bytes(x).decode("utf-8") for x in left], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(cols)])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def oracle(width: int = WIDTH) -> str:
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (
  SELECT rid, doc_id, i, list_aggregate(list_slice(w, i, i + {width - 1}), 'string_agg', ' ') AS g
  FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - {width - 1})) AS i FROM docs WHERE len(w) >= {width})),
late AS (
  SELECT DISTINCT rid, i FROM (SELECT rid, doc_id, i, min((doc_id, i)) OVER (PARTITION BY g) AS least FROM windows)
  WHERE (doc_id, i) > least),
gone AS (SELECT DISTINCT rid, unnest(generate_series(i, i + {width - 1})) AS k FROM late),
each AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM each ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (rid)"""
