"""Digests of whole tables that don't depend on order or partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import numbered


def fingerprint(df: DataFrame, columns: list[str], bits: int = 12) -> DataFrame:
    """One row: digest and number of rows.

    Rows are hashed, hashes are bucketed by prefix, each bucket is summed up by a sum
    and a xor of its 60-bit halves with its count (sums, so map-side), and buckets
    are hashed together: 2**bits small rows.  Null and empty differ.
    """
    cell = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    every = fingerprints(df, [], F.sha2(F.concat_ws("|", *map(cell, columns)).cast("binary"), 256), bits)
    return every.select("fingerprint", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def fingerprints(df: DataFrame, by: list[str], row_hash: Column, bits: int = 12) -> DataFrame:
    """The same for each value of ``by``, of rows that are hashed already (64 hexadecimal digits)."""
    h = df.select(*by, row_hash.alias("h"))
    part = lambda a: F.conv(F.substring("h", a, 12), 16, 10).cast("long")
    n = h.select(*by, (part(1) % (1 << bits)).alias("bucket"), *(part(a).alias(f"p{a}") for a in (1, 13, 25, 37)))
    sums = [F.sum(F.col(f"p{a}").cast("decimal(38,0)")).alias(f"s{a}") for a in (1, 13, 25, 37)] + [F.bit_xor(f"p{a}").alias(f"x{a}") for a in (1, 13, 25, 37)]
    buckets = n.groupBy(*by, "bucket").agg(F.count("*").alias("n"), *sums)
    row = F.struct("bucket", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in buckets.columns if c not in by)).cast("binary"), 256).alias("d"))
    top = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("n").alias("n_rows"))
    return top.select(*by, F.sha2(F.array_join(F.transform("rows", lambda r: r["d"]), "").cast("binary"), 256).alias("fingerprint"), "n_rows")


SNAPSHOT, FANOUT = "source-snapshot-v1", 512


def snapshot_digest(entries: DataFrame, policy_hash: str, contract_hash: str) -> str:
    """What a corpus was compiled from: a digest of its entries (path, size, mtime_ns, hash) in order, its policy and its contract.

    A tree: every FANOUT entries in order of path are framed and hashed, then every
    FANOUT digests, up to one that is hashed with version, policy and contract.
    """
    row = F.concat_ws("\x00", "path", F.col("size").cast("string"), F.col("mtime_ns").cast("string"), F.coalesce("hash", F.lit("")), F.lit(""))
    level = numbered(entries.select("path", "size", "mtime_ns", "hash"), (), "path", "n").select((F.col("n") - 1).alias("n"), row.alias("d"))
    n = level.count()
    while True:
        blocks = level.groupBy(F.floor(F.col("n") / FANOUT).alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "d"))).alias("rows"))
        level = blocks.select("n", F.sha2(F.array_join(F.transform("rows", lambda r: r["d"]), "").cast("binary"), 256).alias("d"))
        n = -(-n // FANOUT)
        if n <= 1:
            break
    top = (level.first() or {"d": ""})["d"]
    return hashlib.sha256("\x00".join((SNAPSHOT, policy_hash, contract_hash, top, "")).encode()).hexdigest()


def scan_fingerprint(scan: DataFrame) -> str:
    return fingerprint(scan, ["path", "size", "mtime_ns"]).first()["fingerprint"]


class UnstableScan(RuntimeError):
    """The corpus changed while it was being read, twice."""


def stable_scan(scan: Callable[[], DataFrame], use: Callable[[DataFrame], object], tries: int = 2) -> object:
    """``use`` on a scan that reads the same before and after; one retry, then an error."""
    for _ in range(tries):
        df = scan()
        before = scan_fingerprint(df)
        out = use(df)
        if scan_fingerprint(scan()) == before:
            return out
    raise UnstableScan("the corpus changed during both passes")
