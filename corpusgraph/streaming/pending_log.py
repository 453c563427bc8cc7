"""The pending set as a log-structured table: a small run for each micro-batch, runs merged by size class.

Of each key (profile_id, path) a run has one row that says what its batches do to the
key: what they clear first (``cleared``: rows up to that generation go), then what
they set.  Such rows can be composed in order of batches, so runs can be merged
without what came before, and a batch writes in proportion to its own rows: FAN runs
of a level become one of the next, so each row is written again once a level.

A run is a folder ``root/run-<level>-<first>-<last>`` of the batches it covers.  Writing
one is idempotent (a replayed batch writes the same run again, or none if a merged run
covers it already), and readers take the widest runs, so a run that is left over
from a merge is passed over until ``vacuum`` removes it.  Writers come one at a time, as
micro-batches do.

Generations of a profile grow from batch to batch; a batch may set and clear the same key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FAN = 8
KEY = ("profile_id", "path")
ROW = "struct<event_kind:string,first_seen:timestamp,last_seen:timestamp,source_generation:bigint,observed_policy_hash:string,observed_policy_generation:bigint,policy_context_known:boolean>"
_NAME = re.compile(r"run-(\d+)-(\d+)-(\d+)$")


def _field(name: str) -> str:
    return re.search(rf"{name}:(\w+)", ROW)[1]


FIELDS = re.findall(r"(\w+):\w+", ROW)


def upserted(a: Column, b: Column) -> Column:
    """Two states of a key, the older first: first seen of the first, everything else of the newer generation."""
    newer = F.struct(b["source_generation"], b["last_seen"]) >= F.struct(a["source_generation"], a["last_seen"])
    pick = lambda c: F.when(newer, b[c]).otherwise(a[c])
    own = {"first_seen": F.least(a["first_seen"], b["first_seen"]), "last_seen": F.greatest(a["last_seen"], b["last_seen"]), "source_generation": F.greatest(a["source_generation"], b["source_generation"])}
    both = F.struct(*(own.get(c, pick(c)).alias(c) for c in FIELDS)).cast(ROW)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def composed(rows: DataFrame) -> DataFrame:
    """One row a key of rows (profile_id, path, batch, cleared, row), in order of batches; FAN rows a key at most."""
    ops = F.array_sort(F.collect_list(F.struct("batch", "cleared", "row")))

    def step(s: Column, o: Column) -> Column:
        # what is cleared is all that was set before; else the clearing meets a newer row and does nothing
        gone = o["cleared"].isNotNull() & (s["row"].isNull() | (s["row"]["source_generation"] <= o["cleared"]))
        cleared = F.when(gone, F.greatest(s["cleared"], o["cleared"])).otherwise(s["cleared"])
        row = F.when(gone, o["row"]).otherwise(upserted(s["row"], o["row"]))
        return F.struct(cleared.alias("cleared"), row.alias("row"))

    start = F.struct(F.lit(None).cast("long").alias("cleared"), F.lit(None).cast(ROW).alias("row"))
    out = rows.groupBy(*KEY).agg(F.max("batch").alias("batch"), F.aggregate(ops, start, step).alias("s"))
    return out.select(*KEY, "batch", F.col("s.cleared").alias("cleared"), F.col("s.row").alias("row"))


class PendingLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self) -> tuple[object, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _all(self) -> list[tuple[int, int, int]]:
        """(level, first, last) of every run that was written whole."""
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        names = [m for s in fs.listStatus(root) if (m := _NAME.search(s.getPath().getName()))]
        done = lambda m: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{m[0]}/_SUCCESS"))
        return sorted(tuple(map(int, m.groups())) for m in names if done(m))

    def runs(self) -> list[tuple[int, int, int]]:
        """The runs that make up the table, in order of batches: those that no wider one covers."""
        found = self._all()
        return sorted((r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)), key=lambda r: r[1])

    def _path(self, run: tuple[int, int, int]) -> str:
        return f"{self.root}/run-{run[0]}-{run[1]}-{run[2]}"

    def _read(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        return self.spark.read.schema(f"profile_id string, path string, batch bigint, cleared bigint, row {ROW}").parquet(*map(self._path, runs))

    def append(self, batch: int, events: DataFrame | None = None, cleared: DataFrame | None = None) -> bool:
        """Write a batch's events, and what it clears (profile_id, path, source_generation); what is cleared goes first.

        False where a merged run has the batch already.
        """
        if any(level and first <= batch <= last for level, first, last in self._all()):
            return False
        none = F.lit(None)
        parts = []
        if cleared is not None:
            parts.append(cleared.groupBy(*KEY).agg(F.max("source_generation").alias("cleared")).select(*KEY, F.col("cleared").cast("long"), none.cast(ROW).alias("row")))
        if events is not None:
            have = events.withColumns({c: (F.lit(False) if c == "policy_context_known" else none).cast(_field(c)) for c in FIELDS if c not in events.columns})
            newest = F.max_by(F.struct(*FIELDS), F.struct("source_generation", "last_seen")).alias("n")
            one = have.groupBy(*KEY).agg(newest, F.min("first_seen").alias("first"), F.max("last_seen").alias("last"))
            fields = {"first_seen": F.col("first"), "last_seen": F.col("last")}
            parts.append(one.select(*KEY, none.cast("long").alias("cleared"), F.struct(*(fields.get(c, F.col(f"n.{c}")).alias(c) for c in FIELDS)).cast(ROW).alias("row")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # both of one key become one row: cleared, then set
        rows = rows.groupBy(*KEY).agg(F.max("cleared").alias("cleared"), F.first("row", ignorenulls=True).alias("row"))
        rows.select(*KEY, F.lit(batch).cast("long").alias("batch"), "cleared", "row").write.mode("overwrite").parquet(self._path((0, batch, batch)))
        return True

    def merge(self) -> list[tuple[int, int, int]]:
        """Merge FAN runs of a level into one of the next, as long as there are so many; returns the new runs."""
        out = []
        while True:
            runs = self.runs()
            levels = {level for level, _, _ in runs}
            ready = next((same[:FAN] for level in sorted(levels) if len(same := [r for r in runs if r[0] == level]) >= FAN), None)
            if ready is None:
                return out
            new = (ready[0][0] + 1, ready[0][1], ready[-1][2])
            composed(self._read(ready)).write.mode("overwrite").parquet(self._path(new))
            out.append(new)

    def vacuum(self) -> int:
        """Remove runs that a wider one covers."""
        fs, _ = self._fs()
        gone = set(self._all()) - set(self.runs())
        for r in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(r)), True)
        return len(gone)

    def read(self) -> DataFrame:
        """The pending rows now: a handful of runs a level, so a handful of rows a key."""
        runs = self.runs()
        schema = "profile_id string, path string, " + ", ".join(f"{c} {_field(c)}" for c in FIELDS)
        if not runs:
            return self.spark.createDataFrame([], schema)
        return composed(self._read(runs)).filter("row IS NOT NULL").select(*KEY, *(f"row.{c}" for c in FIELDS))


def pending_log(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the pending set of a stream of settled or raw event rows; a replayed batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log = PendingLog(batch.sparkSession, root)
        log.append(batch_id, batch)
        log.merge()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
