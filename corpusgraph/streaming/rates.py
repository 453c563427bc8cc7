"""Live rates, stalls and sparse checkpoints of progress frames as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.telemetry import CHECKPOINT_SECONDS, STALL_SECONDS
from .events import keep_state_on_disk

OUT = "run_id string, seq bigint, ts timestamp, bytes_rate double, possible_stall boolean, checkpoint boolean"
_COLUMNS = ["run_id", "seq", "ts", "bytes_rate", "possible_stall", "checkpoint"]


class Rates(StatefulProcessor):
    """One row per frame (run_id, seq, ts, bytes, phase), and one more when a run stalls."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq bigint, t bigint, bytes bigint, progress bigint, kept bigint, phase string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.last.get()) if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            t = r.ts.value // 1000
            size = None if pd.isna(r.bytes) else int(r.bytes)
            if state and r.seq <= state[0]:
                continue  # a frame that was overtaken
            rate, moved, kept = None, bool(size), None
            if state:
                known = size is not None and state[2] is not None
                rate = (size - state[2]) * 1e6 / (t - state[1]) if known and t > state[1] and size >= state[2] else None
                moved = known and size > state[2]
                kept = state[4]
            progress = t if moved else state[3] if state else None
            phase = None if pd.isna(r.phase) else r.phase
            keep = kept is None or t - kept >= CHECKPOINT_SECONDS * 1_000_000 or (state is not None and phase != state[5])
            stalled = progress is not None and t - progress >= STALL_SECONDS * 1_000_000
            out.append((key[0], int(r.seq), r.ts, rate, stalled, keep))
            state = [int(r.seq), t, size, progress, t if keep else kept, phase]
        if state:
            self.last.update(tuple(state))
            for x in list(self.handle.listTimers()):
                self.handle.deleteTimer(x)
            if state[3] is not None:
                self.handle.registerTimer(state[3] // 1000 + STALL_SECONDS * 1000)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.last.get()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], s[0], at, None, True, False)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def live_rates(frames: DataFrame, delay: str = "0 seconds") -> DataFrame:
    keep_state_on_disk(frames.sparkSession)
    return frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("run_id").transformWithStateInPandas(Rates(), OUT, "Append", "EventTime")


def newest_frames(frames: DataFrame) -> DataFrame:
    """Newest frame per run as a stream in update mode; overtaken frames don't replace newer ones."""
    rest = [c for c in frames.columns if c != "run_id"]
    return frames.groupBy("run_id").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("run_id", "s.*")
