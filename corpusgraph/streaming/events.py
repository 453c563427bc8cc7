"""Change events as a stream: classification, coalescing, settled batches, promotion.

One stateful operator per profile keeps pending paths (map state) with a monotonic
generation, in two lanes.  Safe events stay in the fast lane: their batch is due
after a quiet SETTLE, or MAX_DELAY after its first event, whether or not a full pass
is on its way.  A destructive or unknown event, or a profile's very first event
without an earlier success, drops what is pending and asks for a full pass: due
DEBOUNCE after the last such event, DEADLINE after the first at the latest.  A batch
that is a backlog when it falls due asks for a full pass instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.blocks import Blocks

# Event flag bits and timing of the change feed.
PLATFORM, CREATED, UPDATED, REMOVED, RENAMED, MOVED_FROM, MOVED_TO = 1, 2, 4, 8, 16, 128, 256
IS_FILE, IS_DIR, IS_SYMLINK, OVERFLOW = 512, 1024, 2048, 8192
SETTLE, MAX_DELAY, DEBOUNCE, DEADLINE = 3_000, 30_000, 10_000, 60_000
BACKLOG, BACKLOG_SHARE = 500, 0.05
SAFE_KINDS = ("create", "modify")


def event_kind(flags: Column) -> Column:
    """Kind of a raw event; null where it is of no interest."""
    has = lambda *bits: flags.bitwiseAND(F.lit(sum(bits))) != 0
    return (
        F.when((flags == 0) | has(OVERFLOW, PLATFORM) | has(IS_SYMLINK), "other")
        .when(has(IS_DIR) & has(CREATED, REMOVED, RENAMED, MOVED_FROM, MOVED_TO), "other")
        .when(has(IS_DIR), F.lit(None))
        .when(has(REMOVED, RENAMED, MOVED_FROM), "rename")
        .when(has(CREATED, UPDATED, MOVED_TO) & has(IS_FILE), "modify")
        .otherwise("other")
    )


def classified(events: DataFrame) -> DataFrame:
    return events.withColumn("event_kind", event_kind(F.col("flags"))).filter("event_kind IS NOT NULL")


def has_destructive(pending: DataFrame) -> DataFrame:
    return pending.groupBy("profile_id").agg(F.bool_or(~F.col("event_kind").isin(*SAFE_KINDS)).alias("destructive"))


OUT = "profile_id string, action string, path string, event_kind string, first_seen timestamp, last_seen timestamp, source_generation bigint, at timestamp"
_COLUMNS = ["profile_id", "action", "path", "event_kind", "first_seen", "last_seen", "source_generation", "at"]
NEVER, NONE = 1 << 62, -(1 << 62)


def _ts(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


@dataclass
class Lanes:
    """What the operator knows of a profile beside its pending paths; times in milliseconds."""

    gen: int = 0
    first: int = NONE  # first and last event of the open batch, and how many paths it has
    last: int = NONE
    paths: int = 0
    not_before: int = NONE  # of the full pass that is asked for
    deadline: int = NONE
    ledger_rows: int = 0

    def batch_due(self) -> int:
        return min(self.last + SETTLE, self.first + MAX_DELAY) if self.first != NONE else NEVER

    def full_due(self) -> int:
        return min(self.not_before, self.deadline) if self.deadline != NONE else NEVER

    def drop_batch(self) -> None:
        self.first, self.last, self.paths = NONE, NONE, 0

    def promote(self, ms: int) -> None:
        self.drop_batch()
        self.not_before, self.deadline = max(self.not_before, ms + DEBOUNCE), ms + DEADLINE if self.deadline == NONE else self.deadline

    def backlog(self) -> bool:
        return self.paths > BACKLOG or (self.ledger_rows > 0 and self.paths > BACKLOG_SHARE * self.ledger_rows)


class Settle(StatefulProcessor):
    """Emits ``upsert`` rows of a settled batch, or one ``full`` row.

    Input rows: profile_id, session, ts, path, event_kind, ledger_rows, has_success, seq
    (the event's number in its profile, or null: the operator counts itself).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "kind string, first bigint, last bigint, gen bigint")
        self.meta = handle.getValueState("meta", ", ".join(f"{f.name} bigint" for f in fields(Lanes)))

    def _lanes(self) -> Lanes:
        return Lanes(*self.meta.get()) if self.meta.exists() else Lanes()

    def _held(self, lanes: Lanes) -> dict[str, tuple]:
        """The pending paths, read at once: as many as one open batch has."""
        return {k[0]: tuple(v) for k, v in self.pending.iterator()} if lanes.paths else {}

    def _keep(self, lanes: Lanes, held: dict[str, tuple], pending: dict[str, tuple]) -> None:
        """Write what differs from the state as it was read."""
        if held.keys() - pending.keys():
            self.pending.clear()
            held = {}
        for path, v in pending.items():
            if held.get(path) != v:
                self.pending.updateValue((path,), v)
        self.meta.update(astuple(lanes))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (due := min(lanes.batch_due(), lanes.full_due())) < NEVER:
            self.handle.registerTimer(due)

    def _advance(self, profile: str, lanes: Lanes, pending: dict[str, tuple], to: int) -> list[tuple]:
        """What falls due up to ``to``, in order of time; the batch first where both lanes are due."""
        out: list[tuple] = []
        while (at := min(lanes.batch_due(), lanes.full_due())) <= to:
            if at < lanes.batch_due():
                out.append((profile, "full", None, None, None, None, lanes.gen, _ts(at)))
                lanes.not_before = lanes.deadline = NONE
                continue
            if lanes.backlog():
                lanes.promote(at)
            else:
                out += [(profile, "upsert", path, kind, _ts(first), _ts(last), gen, _ts(at)) for path, (kind, first, last, gen) in sorted(pending.items())]
                lanes.drop_batch()
            # pending paths are read and cleared in one step, so no newer version of a path is lost
            pending.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lanes = self._lanes()
        held = self._held(lanes)
        pending = dict(held)
        # a shuffle keeps no order: events of one time and path go by their number, where they have one
        data = pd.concat(list(rows)).sort_values(["ts", "path", "seq"], kind="stable")
        out: list[tuple] = []
        for r in data.itertuples():
            ms = int(r.ts.value // 1_000_000)
            out += self._advance(key[0], lanes, pending, ms)  # what was due before this event goes first
            if pd.isna(r.event_kind):  # a time only
                continue
            lanes.gen = lanes.gen + 1 if pd.isna(r.seq) else int(r.seq)
            lanes.ledger_rows = 0 if pd.isna(r.ledger_rows) else int(r.ledger_rows)
            if r.event_kind not in SAFE_KINDS or (lanes.gen == 1 and not r.has_success):
                lanes.promote(ms)
                pending.clear()
                continue
            old = pending.get(r.path)
            pending[r.path] = (r.event_kind, old[1] if old else ms, ms, lanes.gen)
            lanes.first, lanes.last, lanes.paths = ms if lanes.first == NONE else lanes.first, ms, len(pending)
        self._keep(lanes, held, pending)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lanes = self._lanes()
        held = self._held(lanes)
        pending = dict(held)
        out = self._advance(key[0], lanes, pending, expiredTimerInfo.getExpiryTimeInMs())
        self._keep(lanes, held, pending)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """The stateful operators keep their state in RocksDB, which spills."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # the coordinator of state stores starts with the manager of streams, which a batch run wouldn't touch
    _ = spark.streams.active


def in_sessions(events: DataFrame, tie: str | None = None) -> DataFrame:
    """Bounded events with their number in the profile and the session they belong to.

    Over a gap as long as a debounce both lanes run empty, so that sessions can be
    settled apart from one another; a session ends with the first event behind it,
    which makes due what is left in it.
    """
    rows = Blocks(events, "profile_id", ("ts", "path", *([tie] if tie else []))).scan(number="seq", before={"__before": "ts"})
    gap = F.unix_millis("ts") - F.unix_millis("__before") >= DEBOUNCE + SETTLE + DEBOUNCE
    rows = rows.scan(sums={"session": F.coalesce(gap, F.lit(False)).cast("long")}).done()
    return rows.withColumn("seq", F.col("seq").cast("long")).drop("__before", *([tie] if tie else []))


def settled_batches(events: DataFrame, delay: str = "0 seconds", tie: str | None = None) -> DataFrame:
    """Settled batches of classified events (profile_id, ts, path, event_kind, ledger_rows, has_success), by event time.

    ``tie`` names a column that orders bounded events of one time and path.

    Over a bounded input what isn't due at its end stays pending.
    """
    keep_state_on_disk(events.sparkSession)
    rows = events.select("profile_id", F.col("ts").cast("timestamp").alias("ts"), "path", "event_kind", F.col("ledger_rows").cast("long").alias("ledger_rows"), "has_success", *([tie] if tie else []))
    if events.isStreaming:
        rows = rows.withColumns({"seq": F.lit(None).cast("long"), "session": F.lit(0).cast("long")})
    else:
        told = in_sessions(rows, tie)
        # each session sees the next one's first event as a time only
        ends = told.groupBy("profile_id", "session").agg(F.min("ts").alias("ts")).filter("session > 0")
        none = {c: F.lit(None).cast(told.schema[c].dataType) for c in ("path", "event_kind", "ledger_rows", "has_success", "seq")}
        rows = told.unionByName(ends.withColumns(none | {"session": F.col("session") - 1}))
    return rows.withWatermark("ts", delay).groupBy("profile_id", "session").transformWithStateInPandas(Settle(), OUT, "Append", "EventTime")
