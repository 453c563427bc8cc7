"""Payload columns stored as content-defined chunks.

A payload (UTF-8 of the text, zero bytes appended to a positive multiple of UNIT)
is cut where a rolling gear hash of the last 32 bytes has its low bits zero, within
bounds.  A chunk's digest is its SHA-256.  The store keeps one copy of the bytes
of each digest, with its first occurrence (smallest document and place) as owner;
joins on narrow rows of digests find the owners.  The ordered chunk list of a
payload then collects its chunks again, own ones and those of other owners, and
each is verified by its digest before the payload counts as read back.

Only digests are shuffled to find copies; a chunk's bytes move once to its
payload, and once more if another payload shares them.  The stored form of a
payload is its chunk list followed by its chunks as stored (zstd), so it depends
on the payload alone.

Edge cases: null text counts as empty and stores UNIT zero bytes; rows that
repeat (or share a doc_id) each get their values; an empty table gives no rows; a
chunk that fails its digest raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, slices, utf8

UNIT, LEAST, MEAN_BITS, MOST, STEP = 64, 1024, 11, 16_384, 4 << 20
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
MAGIC = b"CDC1"


def payloads(data: np.ndarray, off: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Each text padded with zero bytes to a positive multiple of ``unit``, end to end, and the offsets."""
    n = np.diff(off)
    size = np.maximum(unit, -(-n // unit) * unit)
    at = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(at[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - off[:-1], n)] = data
    return out, at


def cuts(flat: np.ndarray, at: np.ndarray, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[list[int]]:
    """Chunk ends of each payload, relative to its start.

    The hash of a position reads 32 bytes, fewer than ``least``, so a chunk's cut
    never depends on what lies before the chunk.
    """
    h, reach = GEAR[flat], 1
    while reach < 32:  # h over 2 * reach bytes from two halves
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    hit = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = hit[np.searchsorted(hit, a + least) : np.searchsorted(hit, b)].tolist()
        ends, start = [], a
        for c in own:
            while c - start > most:
                start += most
                ends.append(start - a)
            if c - start >= least:
                ends.append(c - a)
                start = c
        while b - start > most:
            start += most
            ends.append(start - a)
        if b > start:
            ends.append(b - a)
        out.append(ends)
    return out


NO_ID = -(1 << 63)


def _key() -> list[Column]:
    """doc_id (a stand-in where it is null, so that joins keep one partitioning) and th, the hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("th")]


def chunk_rows(docs: DataFrame, with_data: bool) -> DataFrame:
    """One row per chunk: doc_id, th (hash of the text), seq, digest[, data]."""
    rows = docs.select(*_key(), "text")
    schema = "doc_id long, th long, seq int, digest binary" + ", data binary" * with_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=7, write_content_size=True, write_checksum=False)
        for b in slices(batches, "text", STEP):
            data, off = utf8(b.column(2))
            flat, at = payloads(data, off)
            raw = memoryview(flat)
            row, seq, digest, packed = [], [], [], []
            for i, ends in enumerate(cuts(flat, at)):
                start = a = int(at[i])
                for k, e in enumerate(ends):
                    piece = raw[start : a + e]
                    start = a + e
                    row.append(i), seq.append(k), digest.append(hashlib.sha256(piece).digest())
                    if with_data:
                        packed.append(press.compress(piece))
            take = pa.array(row, pa.int32())
            cols = [b.column(0).take(take), b.column(1).take(take), pa.array(seq, pa.int32()), pa.array(digest, pa.binary())]
            if with_data:
                cols.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "seq", "digest", "data"][: len(cols)])

    return rows.mapInArrow(run, schema)


def manifest(chunks: list[tuple[bytes, int]]) -> bytes:
    """The ordered chunk list: digests and stored lengths."""
    return MAGIC + struct.pack("<I", len(chunks)) + b"".join(d + struct.pack("<I", n) for d, n in chunks)


def read_back(chunks: list[tuple[bytes, bytes]]) -> bytes:
    """The payload of an ordered list of (digest, stored chunk); raises where a chunk isn't what its digest says."""
    import zstandard

    out, unpack = [], zstandard.ZstdDecompressor()
    for digest, data in chunks:
        raw = unpack.decompress(data)
        if hashlib.sha256(raw).digest() != digest:
            raise ValueError("a stored chunk doesn't match its digest")
        out.append(raw)
    return b"".join(out)


def features(samples: np.ndarray) -> str:
    """Whole-number features of 8-bit samples: sum, sum of squares, crossings of the middle, distinct values."""
    x = samples.astype(np.int64)
    high = samples >= 128
    return f"sum={int(x.sum())};squares={int((x * x).sum())};crossings={int((high[1:] != high[:-1]).sum())};distinct={len(np.unique(samples))}"


def store_and_read(docs: DataFrame) -> DataFrame:
    """doc_id, th and the values of each distinct (doc_id, text), read from the chunk store."""
    key = ["doc_id", "th"]
    narrow = chunk_rows(docs, False)
    # said once here, the conditions that inner joins imply leave both uses of the exchange alike, so it is reused
    full = chunk_rows(docs, True).filter("doc_id IS NOT NULL AND th IS NOT NULL AND seq IS NOT NULL AND digest IS NOT NULL").repartition(*key)
    place = F.struct("doc_id", "th", "seq")
    owners = narrow.groupBy("digest").agg(F.min(place).alias("owner"), F.max(place).alias("last")).filter("owner <> last").select("digest", "owner")
    # occurrences of chunks that occur elsewhere too: narrow rows
    shared = cut_lineage(narrow.join(owners, "digest").select(*key, "seq", "digest", (place == F.col("owner")).alias("owns")).distinct())
    mine = shared.groupBy(*key).agg(F.collect_set(F.when(~F.col("owns"), F.col("seq"))).alias("elsewhere"), F.collect_set(F.when(F.col("owns"), F.col("seq"))).alias("lends"))
    known = full.join(mine, key, "left")
    own = known.filter(F.col("elsewhere").isNull() | ~F.array_contains("elsewhere", F.col("seq"))).groupBy(*key).agg(F.collect_set(F.struct("seq", "digest", "data")).alias("own"))
    lent = known.filter(F.array_contains("lends", F.col("seq"))).select("digest", "data").dropDuplicates(["digest"])
    fetched = shared.filter("NOT owns").join(lent, "digest").groupBy(*key).agg(F.collect_set(F.struct("seq", "digest", "data")).alias("lent"))
    sizes = docs.select(*_key(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    whole = sizes.join(own, key, "left").join(fetched, key, "left").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "size", "own", "lent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for r in b.to_pylist():
                chunks = [(c["digest"], c["data"]) for c in sorted((r["own"] or []) + (r["lent"] or []), key=lambda c: c["seq"])]
                raw = read_back(chunks)
                if len(raw) != max(UNIT, -(-r["size"] // UNIT) * UNIT):
                    raise ValueError("a payload misses chunks of its list")
                head = manifest([(d, len(x)) for d, x in chunks])
                stored = hashlib.sha256(head)
                for _, x in chunks:
                    stored.update(x)
                values = (r["doc_id"], r["size"], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(head) + sum(len(x) for _, x in chunks), stored.hexdigest(), f"chunks={len(chunks)};" + features(np.frombuffer(raw, np.uint8)))
                for o, v in zip(out, values):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return whole.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
