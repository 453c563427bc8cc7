"""The change feed as watchers write it: a folder of files, one a watcher, of path and flags with a NUL after each.

Files only grow.  An offset names for each file the byte behind its last complete pair
(and the file's time at that moment, which dates the pairs), so a stream that starts
again goes on where it stopped, and a replayed batch reads the same bytes.  A file
beside which ``<name>.done`` lies has ended: a last path without flags counts with flags 0.

The driver looks for borders of pairs in the new bytes, CHUNK bytes at a time, and marks
one every SPLIT bytes: what comes in is read by as many tasks.  Everything goes through
Arrow's file systems (local or shared mounts, and stores that Arrow knows by address).

Empty files and folders give no rows; an empty record where a path is due is passed
over; flags that are no number count as 0; bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHUNK, SPLIT = 1 << 20, 8 << 20
SCHEMA = "feed string, place bigint, ts timestamp, path string, flags bigint"
_ARROW = pa.schema([("feed", pa.string()), ("place", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("path", pa.string()), ("flags", pa.int64())])
DONE = ".done"


def flags_of(record: bytes) -> int:
    """Digits as a number (of 64 bits, as a signed one); anything else is 0."""
    digits = record.strip()
    if not digits.isdigit():
        return 0
    n = int(digits) % (1 << 64)
    return n - (1 << 64) if n >> 63 else n


def pairs(data: bytes, ended: bool = False) -> tuple[list[tuple[int, bytes, bytes]], int]:
    """(place, path, flags) of the complete pairs that ``data`` begins with, and the byte behind the last."""
    out, at, begin, path, used = [], 0, 0, b"", 0
    records = data.split(b"\x00")
    for record in records[:-1]:
        if path:
            out.append((begin, path, record))
            path, used = b"", at + len(record) + 1
        elif record:
            begin, path = at, record
        else:
            used = at + 1
        at += len(record) + 1
    if ended:
        last = records[-1]
        if path or last:
            out.append((begin, path, last) if path else (at, last, b""))
        used = len(data)
    return out, used


class Span(InputPartition):
    def __init__(self, name: str, start: int, end: int, ms: int, ended: bool):
        self.name, self.start, self.end, self.ms, self.ended = name, start, end, ms, ended


class Feed:
    """The files of a feed and the borders of pairs in them."""

    def __init__(self, address: str):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (arrow_fs.LocalFileSystem(), address)
        self.marks: dict[str, list[int]] = {}

    def files(self) -> dict[str, tuple[int, int, bool]]:
        """Size, time in milliseconds and whether it has ended, of each file; hidden names are left out."""
        found = {f.base_name: f for f in self.fs.get_file_info(arrow_fs.FileSelector(self.root, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._"}
        return {n: (f.size, f.mtime_ns // 1_000_000, n + DONE in found) for n, f in sorted(found.items()) if not n.endswith(DONE)}

    def read(self, name: str, start: int, end: int) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            f.seek(start)
            return f.read(end - start)

    def border(self, name: str, size: int, ended: bool) -> int:
        """The byte behind the last complete pair; marks borders on the way."""
        marks = self.marks.setdefault(name, [0])
        at, rest = marks[-1], b""
        begin = at
        while begin + len(rest) < size:
            more = self.read(name, begin + len(rest), min(size, begin + len(rest) + CHUNK))
            if not more:
                break
            rest += more
            used = pairs(rest)[1]
            begin, rest = begin + used, rest[used:]
            if begin - marks[-1] >= SPLIT:
                marks.append(begin)
        return size if ended else begin

    def spans(self, name: str, start: int, end: int, ms: int, ended: bool) -> list[Span]:
        self.border(name, end, False)
        cuts = [start, *(m for m in self.marks[name] if start < m < end), end]
        return [Span(name, a, b, ms, ended and b == end) for a, b in zip(cuts, cuts[1:]) if b > a]


def _rows(address: str, span: Span) -> Iterator[pa.RecordBatch]:
    feed, at, rest = Feed(address), span.start, b""
    while at + len(rest) < span.end:
        more = feed.read(span.name, at + len(rest), min(span.end, at + len(rest) + CHUNK))
        if not more:
            raise OSError(f"{span.name} is shorter than it was")
        rest += more
        found, used = pairs(rest, span.ended and at + len(rest) >= span.end)
        if found:
            n = len(found)
            yield pa.RecordBatch.from_arrays([
                pa.array([span.name] * n), pa.array([at + p for p, _, _ in found], pa.int64()), pa.array([span.ms * 1000] * n, pa.int64()).cast(pa.timestamp("us", "UTC")),
                pa.array([p.decode("utf-8", "replace") for _, p, _ in found]), pa.array([flags_of(f) for _, _, f in found], pa.int64()),
            ], schema=_ARROW)
        if not used and at + len(rest) >= span.end:
            break
        at, rest = at + used, rest[used:]


class FeedReader(DataSourceReader):
    def __init__(self, address: str):
        self.address = address

    def partitions(self) -> list[InputPartition]:
        feed = Feed(self.address)
        return [s for n, (size, ms, ended) in feed.files().items() for s in feed.spans(n, 0, feed.border(n, size, ended), ms, ended)] or [Span("", 0, 0, 0, False)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _rows(self.address, partition)


class FeedStreamReader(DataSourceStreamReader):
    def __init__(self, address: str):
        self.address, self.feed = address, Feed(address)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": {n: [end, ms, ended] for n, (size, ms, ended) in self.feed.files().items() if (end := self.feed.border(n, size, ended))}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before = start["files"]
        return [s for n, (to, ms, ended) in end["files"].items() for s in self.feed.spans(n, before.get(n, [0])[0], to, ms, ended)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _rows(self.address, partition)

    def commit(self, end: dict) -> None:
        pass


class ChangePairs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStreamReader(self.options["path"])


def pair_events(spark: SparkSession, address: str, streaming: bool = False) -> DataFrame:
    """feed, place (byte), ts, path, flags of the pairs below an address: what is there now, or as a stream."""
    spark.dataSource.register(ChangePairs)
    return (spark.readStream if streaming else spark.read).format("change_pairs").load(address)


def below(events: DataFrame, root: str) -> DataFrame:
    """Events with paths relative to the watched root; what isn't below it is left out."""
    r = root.rstrip("/") + "/"
    return events.filter(F.startswith("path", F.lit(r)) & (F.length("path") > len(r))).withColumn("path", F.substring(F.col("path"), F.lit(len(r) + 1), F.length("path")))
