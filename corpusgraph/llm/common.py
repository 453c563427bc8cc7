"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, spread

#: A word is a maximal run of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = read_table(spark, sf_dir, name)
    return spread(rows) if name == "documents" else rows


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the folder the cluster shares.

    The folder is ``spark.checkpoint.dir``.  Where that is unset a session in one
    process (tests) gets a temporary one; on a cluster that is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", ""):
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when their job is done, not when the driver collects its garbage.

    This holds for frames that are made inside and run once (checkpointed, counted), not
    for those that are made here and run later.
    """
    before = spark.conf.get(key := "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]), off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes in each, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary())
        sizes = np.asarray(pa.compute.binary_length(col).fill_null(0), np.int64)
        ends = np.cumsum(sizes)
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])


def u64(*shape) -> np.ndarray:
    return np.zeros(shape, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (a published multiply-xorshift finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, joined end to end."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
