"""Reading a tree of files as a table: every name, nanosecond times, links not followed.

Spark's own file listing hides names that start with a dot or underscore and rounds
times, so listing is a Python data source.  The tree must be on storage that every
executor mounts at the same path.  The driver lists folders from the top
until there are enough for partitions; executors walk the rest.  A folder among those
with more than ``wide`` entries is read by several tasks, each of which looks at the
names that a hash gives it.  As each of them lists the whole folder, there are ``shares``
of them in all at most, dealt to wide folders by their entries: the time of listing
grows with the largest folder, not with its square.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, size bigint, mtime_ns bigint, is_symlink boolean, is_regular boolean"


FOLDERS, WIDE, SHARES = 512, 20_000, 512


class Folder(InputPartition):
    """A folder's own files, or all below it (deep); of a wide one the share-th of so many shares of its names."""

    def __init__(self, path: str, deep: bool, share: int = 0, shares: int = 1):
        self.path, self.deep, self.share, self.shares = path, deep, share, shares


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root = options["path"]
        self.content = "content" in schema.fieldNames()
        self.wide = int(options.get("wide", WIDE))
        self.shares = int(options.get("shares", SHARES))
        self.skip = {d for d in options.get("skipFolders", ".git").split(",") if d}

    def partitions(self) -> list[InputPartition]:
        """Folders, a level deeper until there are FOLDERS of them; those above give their own files only."""
        done: list[tuple[str, bool, int]] = []
        level = [""]
        while level:
            deep, below = len(done) + len(level) >= FOLDERS, []
            for f in sorted(level):
                entries = 0
                for e in os.scandir(os.path.join(self.root, f)):
                    entries += 1
                    if not deep and e.is_dir(follow_symlinks=False) and e.name not in self.skip:
                        below.append(f"{f}/{e.name}" if f else e.name)
                done.append((f, deep, entries))
            level = below
        wide = sum(n for _, _, n in done if n > self.wide)
        out: list[InputPartition] = []
        for f, deep, n in done:
            shares = min(-(-n // self.wide), -(-self.shares * n // wide)) if n > self.wide else 1
            out += [Folder(f, deep, k, shares) for k in range(shares)]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            for e in os.scandir(os.path.join(self.root, folder)):
                # in the folder of the partition itself, names belong to its shares
                if folder == partition.path and partition.shares > 1 and zlib.crc32(os.fsencode(e.name)) % partition.shares != partition.share:
                    continue
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if partition.deep and e.name not in self.skip:
                        todo.append(path)
                    continue
                s = e.stat(follow_symlinks=False)
                regular = e.is_file(follow_symlinks=False)
                row = (path, s.st_size, s.st_mtime_ns, e.is_symlink(), regular)
                if self.content:
                    text = None
                    if regular and path.lower().endswith((".md", ".gitignore")):
                        with open(os.path.join(self.root, path), encoding="utf-8", errors="replace", newline="") as f:
                            text = f.read()
                    row = (*row, text)
                yield row


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA + (", content string" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return CorpusReader(dict(self.options), schema)


def _mounted(root: str) -> str:
    """The path of a folder that driver and executors mount, from a path or a file address."""
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"{root} is not on a file system that is mounted")
    return re.sub("^file:(//)?", "", root)


def scan_corpus(spark: SparkSession, root: str, content: bool = False, wide: int = WIDE) -> DataFrame:
    """path, size, mtime_ns, is_symlink, is_regular[, content of notes and ignore files]."""
    spark.dataSource.register(CorpusSource)
    shares = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("corpus").option("content", str(content).lower()).option("wide", wide).option("shares", shares).load(_mounted(root))


def write_tree(files: DataFrame, root: str) -> None:
    """Write (path, content) rows as files below a mounted folder; the same path written again is replaced."""
    base = _mounted(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = set()
            for path, content in zip(pdf["path"], pdf["content"]):
                target = os.path.join(base, path)
                if (folder := os.path.dirname(target)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                aside = f"{target}.{uuid.uuid4().hex}"
                with open(aside, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.replace(aside, target)
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def coarse(scan: DataFrame) -> DataFrame:
    """The scan with times in whole seconds."""
    return scan.select("path", "size", F.floor(F.col("mtime_ns") / F.lit(1_000_000_000)).cast("long").alias("mtime_s"))


def observed(scan: DataFrame, name: str | Observation = "scan") -> DataFrame:
    """The scan, counting what passes by (visited, eligible) as an observation."""
    return scan.observe(name, F.count(F.lit(1)).alias("visited"), F.count_if(F.col("status") == "eligible").alias("eligible"))
