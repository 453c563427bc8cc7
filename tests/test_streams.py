"""Stateful streams against their batch twins and hand-made timings."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corpusgraph.operators import telemetry
from corpusgraph.streaming import events, rates, sinks

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


SCHEMA = "profile_id string, ts timestamp, path string, event_kind string, ledger_rows long, has_success boolean"


def batches(spark, rows):
    # a batch that isn't due at the end of the input stays in the state; a late event makes the others due
    df = spark.createDataFrame([*rows, ("p", at(100_000), "late.md", "modify", 1_000_000, True)], SCHEMA)
    return sorted((r["profile_id"], r["action"], r["path"], r["at"], r["source_generation"]) for r in events.settled_batches(df).collect())


def test_settle_and_coalesce(spark):
    got = batches(spark, [("p", at(0), "a.md", "modify", 1000, True), ("p", at(1), "a.md", "modify", 1000, True), ("p", at(2), "b.md", "create", 1000, True), ("p", at(20), "c.md", "modify", 1000, True)])
    assert [(r[2], r[3], r[4]) for r in got] == [("a.md", at(5), 2), ("b.md", at(5), 3), ("c.md", at(23), 4)]


def test_max_delay(spark):
    got = batches(spark, [("p", at(2 * k), f"f{k}.md", "modify", 10_000, True) for k in range(20)])
    assert {r[3] for r in got} == {at(30), at(41)} and len(got) == 20


def test_promotions(spark):
    assert batches(spark, [("p", at(0), "a.md", "modify", 1000, True), ("p", at(1), "b.md", "rename", 1000, True)]) == [("p", "full", None, at(11), 2)]
    assert batches(spark, [("p", at(0), "a.md", "modify", 1000, False)]) == [("p", "full", None, at(10), 1)]
    steady = [("p", at(8 * k), "a.md", "other", 1000, True) for k in range(8)]
    assert batches(spark, steady)[0][3] == at(60)  # the deadline holds while events go on
    backlog = [("p", at(0), f"f{k}.md", "modify", 20, True) for k in range(2)]
    assert [r[1] for r in batches(spark, backlog)] == ["full"]


def test_safe_events_beside_a_full_pass(spark):
    """Safe events keep their own lane and don't move the full pass; destructive ones do and drop what is pending."""
    got = batches(spark, [("p", at(0), "a.md", "rename", 1000, True), ("p", at(5), "b.md", "modify", 1000, True), ("p", at(9), "c.md", "modify", 1000, True)])
    assert got == [("p", "full", None, at(10), 3), ("p", "upsert", "b.md", at(8), 2), ("p", "upsert", "c.md", at(12), 3)]
    got = batches(spark, [("p", at(0), "a.md", "modify", 1000, True), ("p", at(1), "b.md", "rename", 1000, True), ("p", at(2), "c.md", "create", 1000, True), ("p", at(40), "d.md", "other", 1000, True)])
    assert got == [("p", "full", None, at(11), 3), ("p", "full", None, at(50), 4), ("p", "upsert", "c.md", at(5), 3)]


def test_only_the_first_event_bootstraps(spark):
    rows = [("p", at(s), f"{s}.md", "modify", 1000, False) for s in (0, 30, 60)]
    assert [(r[1], r[3]) for r in batches(spark, rows)] == [("full", at(10)), ("upsert", at(33)), ("upsert", at(63))]


def test_backlog_is_judged_when_due(spark):
    """Three paths of 40 are a backlog at the batch's end, not before; the same path again is none."""
    rows = [("p", at(0), "a.md", "modify", 40, True), ("p", at(1), "a.md", "modify", 40, True), ("p", at(2), "b.md", "modify", 40, True)]
    assert [r[1] for r in batches(spark, rows)] == ["upsert", "upsert"]
    got = batches(spark, [*rows, ("p", at(4), "c.md", "modify", 40, True)])
    assert [(r[1], r[3]) for r in got] == [("full", at(17))]


def test_sessions_are_as_one_fold(spark, tmp_path):
    """The stream, one state a profile, gives what the bounded run gives session by session."""
    rng = random.Random(4)
    t, rows = 0, []
    for k in range(160):
        t += rng.choice((0, 1, 2, 4, 9, 12, 25, 70))
        rows.append((f"p{k % 2}", at(t), f"f{rng.randrange(6)}_{k}.md", rng.choice(("modify", "create", "modify", "rename")), 1000, True))
    rows += [(p, at(t + 5000), "late.md", "modify", 10**6, True) for p in ("p0", "p1")]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = events.settled_batches(spark.readStream.schema(df.schema).json(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    key = lambda d: sorted(map(str, d.select("profile_id", "action", "path", "event_kind", "source_generation", "at").collect()))
    assert key(spark.table("settled").filter("path IS NULL OR path <> 'late.md'")) == key(events.settled_batches(df)) and len(key(events.settled_batches(df))) > 60


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r1", k, at(60 * k), 100 * k if k % 3 else None, "uploading") for k in range(12)]
    df = spark.createDataFrame(rows, "run_id string, seq long, ts timestamp, bytes long, phase string")
    df.write.json(str(tmp_path / "in"))
    stream = rates.live_rates(spark.readStream.schema(df.schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["seq"]: r["bytes_rate"] for r in spark.table("live").filter("NOT possible_stall").collect()}
    want = {r["seq"]: r["bytes_rate"] for r in telemetry.rates(df, ("bytes",)).collect()}
    assert got == want
    assert [r["seq"] for r in spark.table("live").filter("checkpoint").orderBy("seq").collect()] == [r["seq"] for r in telemetry.checkpoints(df).orderBy("seq").collect()]


def test_stall_and_checkpoint(spark):
    rows = [("r", k, at(600 * k), 5, "uploading" if k < 5 else "finalizing") for k in range(14)]
    df = spark.createDataFrame(rows, "run_id string, seq long, ts timestamp, bytes long, phase string")
    full = df.select("*", *(F.lit(None).cast("long").alias(c) for c in ("checks", "transfers", "listed", "deletes", "item_bytes")), F.lit(None).cast("string").alias("item"))
    stalled = [r["seq"] for r in telemetry.stalls(telemetry.measurable(full)).filter("possible_stall").orderBy("seq").collect()]
    assert stalled == list(range(3, 14))
    assert sorted(r["seq"] for r in telemetry.checkpoints(df).collect()) == [0, 5, 11]


def test_pending_sink_is_idempotent(spark, tmp_path):
    rows = [("p", "a.md", "modify", at(0), at(0), 1), ("p", "a.md", "delete", at(5), at(5), 2), ("p", "b.md", "modify", at(6), at(6), 3)]
    df = spark.createDataFrame(rows, "profile_id string, path string, event_kind string, first_seen timestamp, last_seen timestamp, source_generation long")
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    sinks.pending_log(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = {r["path"]: (r["event_kind"], r["first_seen"], r["source_generation"]) for r in sinks.PendingLog(spark, str(tmp_path / "out")).read().collect()}
    assert got == {"a.md": ("delete", at(0), 2), "b.md": ("modify", at(6), 3)}


def test_rebuild_on_change(spark):
    scan = spark.createDataFrame([("a", 1, 1)], "path string, size long, mtime_ns long")
    built = []
    known = sinks.rebuild_on_change(scan, None, built.append)
    assert sinks.rebuild_on_change(scan, known, built.append) == known and len(built) == 1


class _Maps:
    """A state handle in memory: one map, one value, no timers."""

    def __init__(self):
        self.rows, self.value = {}, None

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def iterator(self):
        return iter(list(self.rows.items()))

    def clear(self):
        self.rows.clear()

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return []

    deleteTimer = registerTimer = lambda self, t: None


def test_events_of_one_time_and_path_go_by_number():
    """However a shuffle hands them over, the newest event of a path is the one with the highest number; pending paths survive in the state."""
    import itertools

    import pandas as pd

    rows = [("a.md", "create", 1), ("a.md", "modify", 2), ("a.md", "create", 3), ("b.md", "modify", 4)]
    columns = ["ts", "path", "event_kind", "ledger_rows", "has_success", "seq"]
    for success, want in ((True, [("a.md", "create", 3), ("b.md", "modify", 4)]), (False, [(None, None, 4), ("a.md", "create", 3), ("b.md", "modify", 4)])):
        for order in itertools.permutations(rows):
            settle = events.Settle()
            settle.init(_Maps())
            got = pd.concat(settle.handleInputRows(("p", 0), iter([pd.DataFrame([(pd.Timestamp(at(0)), p, k, 1000, success, float(n)) for p, k, n in order], columns=columns)]), None))
            assert got.empty and set(settle.pending.rows) == {("a.md",), ("b.md",)}
            late = pd.DataFrame([(pd.Timestamp(at(100)), None, None, None, None, None)], columns=columns)
            got = pd.concat(settle.handleInputRows(("p", 0), iter([late]), None))
            key = lambda r: (r[0] is not None, str(r[0]))
            assert sorted(((r.path, r.event_kind, r.source_generation) for r in got.itertuples()), key=key) == want and not settle.pending.rows
