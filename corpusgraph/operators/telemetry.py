"""Progress logs, rates, stalls, retries, error classes and health of a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import parsed_time
from .blocks import Blocks

FRAME = (
    "level string, msg string, time string, stats struct<bytes:bigint,totalBytes:bigint,checks:bigint,totalChecks:bigint,transfers:bigint,totalTransfers:bigint,listed:bigint,deletes:bigint,"
    "errors:bigint,speed:double,transferring:array<struct<name:string,bytes:bigint,size:bigint>>,currentTransfers:array<struct<name:string,bytes:bigint,size:bigint>>>"
)
COUNTERS = ("bytes", "checks", "transfers", "listed", "deletes")
STALL_SECONDS, CHECKPOINT_SECONDS, STALE_HOURS = 30 * 60, 3600, 26
# Fixed value: phases in which bytes move.
TRANSFER_PHASES = ("uploading", "transferring")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, of a timestamp with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def progress_frames(lines: DataFrame) -> DataFrame:
    """Frames of JSON log lines (run_id, seq, ts, line); a line without stats gives no row, an absent counter is null."""
    s = F.col("frame.stats")
    active = F.coalesce(s["transferring"], s["currentTransfers"])
    first = F.get(active, F.lit(0))
    parsed = lines.withColumn("frame", F.from_json("line", FRAME)).filter(s.isNotNull())
    return parsed.select(
        "run_id", "seq", F.coalesce(parsed_time("frame.time"), F.col("ts")).alias("ts"),
        s["bytes"].alias("bytes"), s["totalBytes"].alias("total_bytes"), s["checks"].alias("checks"), s["totalChecks"].alias("total_checks"),
        s["transfers"].alias("transfers"), s["totalTransfers"].alias("total_transfers"), s["listed"].alias("listed"), s["deletes"].alias("deletes"), s["errors"].alias("errors"), s["speed"].alias("speed"),
        F.when(active.isNotNull(), F.size(active)).cast("long").alias("active_transfers"),
        first["name"].alias("item"), first["bytes"].alias("item_bytes"), first["size"].alias("item_size"),
    )


def rates(frames: DataFrame, counters: tuple[str, ...] = ("bytes", "transfers"), key: str = "run_id") -> DataFrame:
    """Rate of each counter against the frame before; null where unknown, 0 where nothing moved."""
    rows = Blocks(frames, key, "seq").scan(before={f"__p_{c}": c for c in ("ts", *counters)}).done()
    dt = micros("ts") - micros("__p_ts")
    rate = lambda d: F.when((dt > 0) & (d >= 0), d * F.lit(1e6) / dt)
    return rows.select(*frames.columns, *(rate(F.col(c) - F.col(f"__p_{c}")).alias(f"{c}_rate") for c in counters))


def _measured(frames: Blocks) -> Blocks:
    own, rows = frames.rows.columns, frames.scan(before={f"__p_{c}": c for c in ("seq", "item", "item_bytes", *COUNTERS)}).rows
    first = F.col("__p_seq").isNull()
    up = lambda c: F.coalesce(F.col(c) > F.col(f"__p_{c}"), F.lit(False))
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    item = F.col("item").isNotNull() & ~F.col("item").eqNullSafe(F.col("__p_item"))
    start, later = F.coalesce(F.col("item") != "", F.lit(False)), item | up("item_bytes")
    for c in COUNTERS:
        start, later = start | some(c), later | up(c)
    return frames.over(rows.select(*own, F.when(first, start).otherwise(later).alias("measurable")))


def measurable(frames: DataFrame, key: str = "run_id") -> DataFrame:
    """Whether work advanced since the frame before."""
    return _measured(Blocks(frames, key, "seq")).done()


def stalls(frames: DataFrame, key: str = "run_id", after: int = STALL_SECONDS) -> DataFrame:
    """Last measurable progress at each frame, and whether the run may be stalled; ``measurable`` is found first where it isn't there."""
    rows = Blocks(frames, key, "seq")
    rows = rows if "measurable" in frames.columns else _measured(rows)
    rows = rows.scan(last={"last_progress": F.when(F.col("measurable"), F.col("ts"))}).done()
    return rows.withColumn("possible_stall", F.coalesce(micros("ts") - micros("last_progress") >= after * 1_000_000, F.lit(False)))


def upload_start(frames: DataFrame, key: str = "run_id") -> DataFrame:
    return frames.groupBy(key).agg(F.min(F.when(F.col("phase") == "uploading", F.col("ts"))).alias("upload_started_at"))


def heartbeats(frames: DataFrame, key: str = "run_id") -> DataFrame:
    return frames.groupBy(key).agg(F.max("ts").alias("last_heartbeat_at"), F.max(F.when(F.col("measurable"), F.col("ts"))).alias("last_progress_at"))


def newest_status(frames: DataFrame, key: str = "run_id", seq: str = "seq") -> DataFrame:
    rest = [c for c in frames.columns if c != key]
    return frames.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("s")).select(key, "s.*")


def newest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    w = Window.partitionBy("profile_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def backoff_seconds(failures: Column) -> Column:
    """Capped exponential delay of the n-th failure in a row, without jitter."""
    n = F.least(F.greatest(failures, F.lit(1)) - 1, F.lit(10))
    return F.least(F.pow(F.lit(2.0), n).cast("long"), F.lit(1800))


def limited_seconds(failures: Column) -> Column:
    return F.when(failures == 1, 60).when(failures == 2, 300).otherwise(900)


def retries(runs: DataFrame) -> DataFrame:
    """Failures in a row since the last success, the class after limits, and the next retry.

    runs: profile_id, seq, status, classification, completed_at.
    """
    kinds = {"consecutive": "retryable", "limited": "retryable_limited"}
    one = lambda c: F.when((F.col("status") == "failed") & (F.col("classification") == c), 1).otherwise(0)
    # failures since a success: all so far less all up to the last success
    rows = Blocks(runs, "profile_id", "seq").scan(sums={f"__{n}": one(c) for n, c in kinds.items()})
    rows = rows.scan(last={f"__s_{n}": F.when(F.col("status") == "succeeded", F.col(f"__{n}")) for n in kinds}).done()
    r = rows.select(*runs.columns, *((F.col(f"__{n}") - F.coalesce(F.col(f"__s_{n}"), F.lit(0))).alias(n) for n in kinds))
    failed = F.col("status") == "failed"
    final = F.when((F.col("classification") == "retryable_limited") & (F.col("limited") > 3), "terminal").otherwise(F.col("classification"))
    delay = F.when(failed & (final == "retryable"), backoff_seconds(F.col("consecutive"))).when(failed & (final == "retryable_limited"), limited_seconds(F.col("limited")))
    return r.withColumn("final_classification", F.when(failed, final)).withColumn("delay_seconds", delay.cast("long")).withColumn("next_retry_at", F.timestamp_micros(micros("completed_at") + F.col("delay_seconds") * 1_000_000))


def error_class(code: Column, exit_code: Column, temporary: Column | None = None) -> Column:
    """retryable, retryable_limited or terminal, of an error code or exit status.

    ``temporary`` tells ownership errors: true for those that pass, false for those
    that don't, null for errors of another kind.
    """
    return (
        F.when(temporary if temporary is not None else F.lit(False), "retryable")
        .when(temporary.isNotNull() if temporary is not None else F.lit(False), "terminal")
        .when(code.isin("context_canceled", "source_unstable", "worker_interrupted"), "retryable")
        .when(code == "delete_budget_exceeded", "terminal")
        .when(exit_code == 5, "retryable")
        .when(exit_code.isin(2, 6, 7), "terminal")
        .when(exit_code.isNotNull(), "retryable_limited")
        .otherwise("terminal")
    )


def quota_band(free: Column, warn_free_bytes: int) -> Column:
    return F.when(free == 0, "full").when((free >= 0) & F.lit(warn_free_bytes > 0) & (free < warn_free_bytes), "low").otherwise("ok")


def health(fleet: DataFrame, now: Column, warn_free_bytes: int = 0) -> DataFrame:
    """Health label of each profile, first rule that holds.

    fleet: tombstoned, deletion_requested_at, enabled, has_runtime, sync_state,
    reconcile_requested, last_reconcile_success, last_error, free_bytes (null: never measured).
    """
    stale = micros(now) - micros("last_reconcile_success") > STALE_HOURS * 3600 * 1_000_000
    quota = quota_band(F.col("free_bytes"), warn_free_bytes)
    label = (
        F.when(F.col("tombstoned"), "TOMBSTONED")
        .when(F.col("deletion_requested_at").isNotNull(), "DELETING")
        .when(~F.col("enabled"), "DISABLED")
        .when(~F.col("has_runtime"), "STALE")
        .when(F.col("sync_state") == "initializing", "INITIALIZING")
        .when(F.col("sync_state") == "syncing", "SYNCING")
        .when(F.col("sync_state") == "error", "BROKEN")
        .when(F.col("reconcile_requested"), "RECONCILE_REQUESTED")
        .when(stale, "STALE")
        .when(F.coalesce(F.col("last_error"), F.lit("")) != "", "BROKEN")
        .when(quota == "full", "QUOTA_FULL")
        .when(quota == "low", "QUOTA_LOW")
        .otherwise("HEALTHY")
    )
    return fleet.withColumn("health", label)


def fleet_status(profiles: DataFrame, sync: DataFrame, runs: DataFrame, policy: DataFrame, prune: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per active profile from six tables; a live row (sync) overrides the run's phase."""
    from .ledger import ledger_counts, newest_open

    last = newest_runs(runs, 1).select("profile_id", "run_id", F.col("phase").alias("run_phase"))
    act = profiles.filter("NOT tombstoned")
    return (
        act.join(sync, "profile_id", "left")
        .join(last, "profile_id", "left")
        .join(policy.select("profile_id", F.col("hash").alias("policy_hash")), "profile_id", "left")
        .join(newest_open(prune).select("profile_id", "request_id", F.col("state").alias("prune_state")), "profile_id", "left")
        .join(ledger_counts(ledger), "profile_id", "left")
        .withColumn("phase", F.coalesce("phase", "run_phase"))
        .drop("run_phase")
    )


def log_summary(lines: DataFrame) -> DataFrame:
    """Leading whole number of the last Transferred: and Deleted: line of each run (run_id, line_no, line)."""
    number = F.regexp_extract("line", r"(?:Transferred|Deleted):\s*([+-]?\d+)", 1)
    last = lambda label: F.max_by(F.when(number != "", number).cast("long"), F.when(F.col("line").contains(label) & (number != ""), F.col("line_no")))
    return lines.groupBy("run_id").agg(F.coalesce(last("Transferred:"), F.lit(0)).alias("transferred"), F.coalesce(last("Deleted:"), F.lit(0)).alias("deleted"))


def checkpoints(frames: DataFrame, key: str = "run_id", seconds: int = CHECKPOINT_SECONDS) -> DataFrame:
    """Sparse frames worth keeping: the first, phase changes, and the first of each further hour since the last kept one.

    The greedy hour is a fold, but only over one stretch between frames that are kept
    in any case: the first, a phase change, or one an hour or more after the frame
    before it (so an hour after the last kept one as well).
    """
    rows = Blocks(frames.select(key, "seq", "ts", "phase"), key, "seq").scan(before={"p_phase": "phase", "p_seq": "seq"}, highest_before={"ahead": micros("ts")})
    turned = F.col("phase").isNotNull() & ~F.col("phase").eqNullSafe(F.col("p_phase"))
    alone = F.col("ahead").isNull() | (micros("ts") - F.col("ahead") >= seconds * 1_000_000)
    rows = rows.scan(sums={"stretch": (turned | F.col("p_seq").isNull() | alone).cast("long")}).done()
    rows = rows.withColumn("forced", turned | F.col("p_seq").isNull() | alone)
    each = rows.groupBy(key, "stretch").agg(F.array_sort(F.collect_list(F.struct("seq", micros("ts").alias("t"), "forced"))).alias("f"))
    start = F.struct(F.lit(None).cast("long").alias("at"), F.array().cast("array<bigint>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        due = x["forced"] | s["at"].isNull() | (x["t"] - s["at"] >= seconds * 1_000_000)
        return F.when(due, F.struct(x["t"].alias("at"), F.concat(s["kept"], F.array(x["seq"].cast("long"))).alias("kept"))).otherwise(s)

    kept = each.select(key, F.explode(F.aggregate("f", start, step)["kept"]).alias("seq"))
    return frames.join(kept, [key, "seq"], "left_semi")
