"""The managed ledger: diffs, state changes, prune sets, orphans, duplicates, verification.

Every change is a join that yields a new snapshot; nothing is updated in place.
Ledger rows: profile_id, rel_path, size, mod_time, hash, state (active, suppressed,
protected), suppressed_policy_hash, suppressed_generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import paths as P
from .blocks import Blocks, numbered

KEY = ["profile_id", "rel_path"]
LEDGER = ["profile_id", "rel_path", "size", "mod_time", "hash", "state", "suppressed_policy_hash", "suppressed_generation"]
BATCH = 512
# States of a prune request that still wait for something.
OPEN_REQUESTS = ("preview", "authorized", "running")
UNEXECUTED = ("preview", "approval_required")
DESTRUCTIVE = ("delete", "rename", "other")


def _beside(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in KEY})


def diff_ledger(scan: DataFrame, ledger: DataFrame, ledger_states: tuple[str, ...] | None = ("active",)) -> DataFrame:
    """Paths that changed or disappeared: profile_id, rel_path, change (changed, deleted).

    ``ledger_states=None`` compares with rows of every state.
    """
    old = ledger if ledger_states is None else ledger.filter(F.col("state").isin(*ledger_states))
    new = scan.select(*KEY, F.col("size").alias("n_size"), F.col("mod_time").alias("n_time"), F.lit(True).alias("here"))
    both = new.join(old.select(*KEY, F.col("size").alias("o_size"), F.col("mod_time").alias("o_time"), F.lit(True).alias("known")), KEY, "full_outer")
    same = F.col("n_size").eqNullSafe(F.col("o_size")) & F.col("n_time").eqNullSafe(F.col("o_time"))
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("known").isNull() | ~same, "changed")
    return both.select(*KEY, change.alias("change")).filter("change IS NOT NULL")


def catch_up_events(scan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Change events that a diff over all ledger states stands for."""
    return diff_ledger(scan, ledger, None).select(*KEY, F.when(F.col("change") == "deleted", "delete").otherwise("modify").alias("event_kind"))


def sync_now_paths(scan: DataFrame, ledger: DataFrame, pending: DataFrame) -> DataFrame:
    """Changed and pending paths, with ``full`` where the profile also lost paths."""
    d = diff_ledger(scan, ledger)
    gone = d.groupBy("profile_id").agg(F.bool_or(F.col("change") == "deleted").alias("full"))
    some = d.filter("change = 'changed'").select(*KEY).union(pending.select(*KEY)).distinct()
    return some.join(gone, "profile_id", "left").withColumn("full", F.coalesce("full", F.lit(False)))


def classify_disappearances(ledger: DataFrame, eligible: DataFrame, pending: DataFrame, policy_hash: str, ignored: DataFrame) -> DataFrame:
    """Active paths absent from the eligible scan: ``verdict`` delete (proven) or suppress.

    ignored: distinct keys that the committed policy ignores now.
    """
    gone = ledger.filter("state = 'active'").join(eligible.select(*KEY), KEY, "left_anti").select(*KEY)
    proof = pending.filter(F.col("event_kind").isin(*DESTRUCTIVE) & F.col("policy_context_known") & (F.col("observed_policy_hash") != policy_hash))
    proof = proof.select(F.col("profile_id"), F.col("path").alias("rel_path")).distinct().withColumn("proven", F.lit(True))
    hidden = ignored.select(*KEY).distinct().withColumn("hidden", F.lit(True))
    j = gone.join(proof, KEY, "left").join(hidden, KEY, "left")
    return j.select(*KEY, F.when(F.col("proven") | F.col("hidden").isNull(), "delete").otherwise("suppress").alias("verdict"))


def refresh_ledger(ledger: DataFrame, eligible: DataFrame, proven: DataFrame, policy_hash: str, generation: int) -> DataFrame:
    """The ledger under a new policy: eligible suppressed rows return, unproven losses are suppressed."""
    here = eligible.select(*KEY).distinct().withColumn("here", F.lit(True))
    kept = proven.select(*KEY).distinct().withColumn("proven", F.lit(True))
    j = ledger.join(here, KEY, "left").join(kept, KEY, "left")
    back = (F.col("state") == "suppressed") & F.coalesce("here", F.lit(False))
    hide = (F.col("state") == "active") & F.col("here").isNull() & F.col("proven").isNull()
    out = j.withColumns({
        "suppressed_policy_hash": F.when(hide, F.lit(policy_hash)).when(~back, F.col("suppressed_policy_hash")),
        "suppressed_generation": F.when(hide, F.lit(generation).cast("long")).when(~back, F.col("suppressed_generation")),
        "state": F.when(hide, "suppressed").when(back, "active").otherwise(F.col("state")),
    })
    return out.select(*LEDGER)


def apply_ledger(ledger: DataFrame, desired: DataFrame, delete_stale: bool = True) -> DataFrame:
    """Upsert the desired rows; suppressed and protected states survive, stale active rows go."""
    new = desired.select(*KEY, F.col("size").alias("n_size"), F.col("mod_time").alias("n_time"), F.col("hash").alias("n_hash"), F.lit(True).alias("wanted"))
    j = ledger.join(new, KEY, "full_outer")
    if delete_stale:
        j = j.filter(F.col("wanted") | (F.col("state") != "active"))
    w = F.coalesce("wanted", F.lit(False))
    return j.select(
        *KEY,
        *(F.when(w, F.col(n)).otherwise(F.col(o)).alias(o) for o, n in (("size", "n_size"), ("mod_time", "n_time"), ("hash", "n_hash"))),
        F.coalesce("state", F.lit("active")).alias("state"),
        "suppressed_policy_hash",
        "suppressed_generation",
    )


def mark_suppressed(ledger: DataFrame, keys: DataFrame, policy_hash: str, generation: int) -> DataFrame:
    j = ledger.join(keys.select(*KEY).distinct().withColumn("m", F.lit(True)), KEY, "left")
    m = F.col("m") & (F.col("state") != "protected")
    return j.withColumns({"suppressed_policy_hash": F.when(m, F.lit(policy_hash)).otherwise(F.col("suppressed_policy_hash")), "suppressed_generation": F.when(m, F.lit(generation).cast("long")).otherwise(F.col("suppressed_generation")), "state": F.when(m, "suppressed").otherwise(F.col("state"))}).select(*LEDGER)


def reactivate(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    j = ledger.join(keys.select(*KEY).distinct().withColumn("m", F.lit(True)), KEY, "left")
    m = F.col("m").isNotNull() & (F.col("state") != "protected")
    return j.withColumns({"suppressed_policy_hash": F.when(~m, F.col("suppressed_policy_hash")), "suppressed_generation": F.when(~m, F.col("suppressed_generation")), "state": F.when(m, "active").otherwise(F.col("state"))}).select(*LEDGER)


def delete_rows(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    return ledger.join(keys.select(*KEY), KEY, "left_anti")


def ledger_counts(ledger: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(f"{s}_count")
    return ledger.groupBy("profile_id").agg(F.count("*").alias("total"), n("active"), n("suppressed"), n("protected"))


def unmanaged_orphans(remote: DataFrame, ledger: DataFrame, ignored: DataFrame) -> DataFrame:
    """Distinct remote paths that no ledger row names and the policy ignores."""
    return remote.select(*KEY).distinct().join(ledger.select(*KEY), KEY, "left_anti").join(ignored.select(*KEY), KEY, "left_semi")


def still_unmanaged(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Valid candidates, without those that became managed meanwhile."""
    valid = candidates.filter(P.is_canonical("rel_path") & ~P.is_reserved("rel_path")).select(*KEY).distinct()
    return valid.join(ledger.select(*KEY), KEY, "left_anti")


def classify_targets(targets: DataFrame, remote: DataFrame) -> DataFrame:
    there = remote.select(*KEY).distinct().withColumn("there", F.lit(True))
    return targets.join(there, KEY, "left").withColumn("presence", F.when(F.col("there"), "existing").otherwise("missing")).drop("there")


def verify_one_way(source: DataFrame, target: DataFrame, mode: str = "size") -> DataFrame:
    """Source rows that the target lacks or holds differently: problem missing, size_differs or hash_differs."""
    j = source.join(_beside(target.select(*KEY, "size", "hash"), "t_").withColumn("t_here", F.lit(True)), KEY, "left")
    problem = F.when(F.col("t_here").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("t_size")), "size_differs")
    if mode == "hash":
        problem = problem.when(~F.col("hash").eqNullSafe(F.col("t_hash")), "hash_differs")
    return j.select(*KEY, problem.alias("problem")).filter("problem IS NOT NULL")


def duplicate_paths(remote: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    return remote.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def eligible_events(pending: DataFrame, scan: DataFrame, ignored: DataFrame) -> DataFrame:
    """Pending events with their fate: eligible, stale (no such file) or excluded (ignored)."""
    here = scan.select(*KEY).distinct().withColumn("here", F.lit(True))
    hide = ignored.select(*KEY).distinct().withColumn("hide", F.lit(True))
    j = pending.join(here, KEY, "left").join(hide, KEY, "left")
    return j.withColumn("fate", F.when(F.col("hide"), "excluded").when(F.col("here"), "eligible").otherwise("stale")).drop("here", "hide")


def pending_summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("profile_id").agg(F.count("*").alias("pending"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def upsert_pending(pending: DataFrame, events: DataFrame) -> DataFrame:
    """One row per path: first_seen of the first, largest generation, kind and policy context of the newest.

    Frames without a policy context get one that isn't known.
    """
    unknown = {"observed_policy_hash": F.lit(None).cast("string"), "observed_policy_generation": F.lit(None).cast("long"), "policy_context_known": F.lit(False)}
    both = [d.withColumns({c: v for c, v in unknown.items() if c not in d.columns}) for d in (pending, events)]
    newest = F.max_by(F.struct("event_kind", *unknown), F.struct("source_generation", "last_seen")).alias("newest")
    rows = both[0].unionByName(both[1]).groupBy("profile_id", "path").agg(newest, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("source_generation").alias("source_generation"))
    return rows.select("profile_id", "path", "newest.event_kind", "first_seen", "last_seen", "source_generation", *(f"newest.{c}" for c in unknown))


def by_first_seen(pending: DataFrame) -> DataFrame:
    """Pending rows in the order in which their paths were first seen, numbered per profile."""
    return numbered(pending, "profile_id", ("first_seen", "path"), "place").withColumn("place", F.col("place").cast("int")).orderBy("profile_id", "place")


def first_skipped(scan: DataFrame, limit: int = 10) -> DataFrame:
    """The first skipped symlinks of each profile (profile_id, path, is_symlink), each with the number of further ones."""
    links = scan.filter("is_symlink").select("profile_id", "path")
    w = Window.partitionBy("profile_id").orderBy("path")
    total = links.groupBy("profile_id").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))
    return links.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).join(total, "profile_id")


def clear_pending(pending: DataFrame, batch: DataFrame) -> DataFrame:
    """Pending rows without those whose stored generation the batch has reached."""
    b = batch.select("profile_id", "path", F.col("source_generation").alias("done"))
    j = pending.join(b.groupBy("profile_id", "path").agg(F.max("done").alias("done")), ["profile_id", "path"], "left")
    return j.filter(F.col("done").isNull() | (F.col("source_generation") > F.col("done"))).drop("done")


def preflight(scan: DataFrame, diff: DataFrame, max_delete: int) -> DataFrame:
    """Per profile: files, to_copy, to_delete and whether the deletion budget allows it."""
    files = scan.groupBy("profile_id").agg(F.count("*").alias("source_files"))
    work = diff.groupBy("profile_id").agg(F.count_if(F.col("change") == "changed").alias("to_copy"), F.count_if(F.col("change") == "deleted").alias("to_delete"))
    return files.join(work, "profile_id", "full_outer").fillna(0).withColumn("within_budget", F.col("to_delete") <= max_delete)


def budgeted(diff: DataFrame, max_delete: int) -> DataFrame:
    """The diff of the profiles that keep to their deletion budget."""
    over = diff.groupBy("profile_id").agg(F.count_if(F.col("change") == "deleted").alias("n")).filter(F.col("n") > max_delete)
    return diff.join(over.select("profile_id"), "profile_id", "left_anti")


def prune_requests(ledger: DataFrame, policy: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Requests after a new preview of each ready profile (profile_id, hash, ..., max_delete).

    The preview carries the number of its targets and a digest of their paths; older
    previews of the profile that nobody has executed are superseded.
    requests: profile_id, request_id, policy_hash, state, created_at.
    """
    rows = freeze_prune(ledger, policy).groupBy("profile_id").agg(F.count("*").alias("candidate_count"))
    ready = policy.filter((F.col("refresh_state") == "ready") & (F.col("refreshed_hash") == F.col("hash"))).select("profile_id", F.col("hash").alias("policy_hash"), "max_delete")
    digests = path_digests(freeze_prune(ledger, policy))
    preview = ready.join(rows, "profile_id", "left").join(digests, "profile_id", "left").select(
        "profile_id", F.concat(F.lit("prune-"), "profile_id", F.lit("-"), F.date_format(at, "yyyyMMddHHmmss")).alias("request_id"), "policy_hash", F.lit("preview").alias("state"), at.alias("created_at"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("candidate_digest", F.sha2(F.lit("").cast("binary"), 256)).alias("candidate_digest"), F.col("max_delete").alias("default_max_delete"),
    )
    fresh = preview.select("profile_id").withColumn("fresh", F.lit(True))
    old = requests.join(fresh, "profile_id", "left").withColumn("state", F.when(F.col("fresh") & F.col("state").isin(*UNEXECUTED), "superseded").otherwise(F.col("state"))).drop("fresh")
    return old.unionByName(preview, allowMissingColumns=True)


def path_digests(targets: DataFrame) -> DataFrame:
    """Per profile, a digest of its target paths in order, over digests of blocks of BATCH paths (profile_id, candidate_digest)."""
    blocks = batched(targets.select(*KEY)).groupBy("profile_id", "batch").agg(F.array_sort(F.collect_list("rel_path")).alias("p"))
    each = blocks.select("profile_id", "batch", L.framed_digest(F.array_join("p", "\x00"), F.lit("")).alias("d"))
    every = F.array_sort(F.collect_list(F.struct("batch", "d")))
    return each.groupBy("profile_id").agg(L.framed_digest(F.array_join(F.transform(every, lambda b: b["d"]), "\x00"), F.lit("")).alias("candidate_digest"))


def freeze_prune(ledger: DataFrame, policy: DataFrame) -> DataFrame:
    """Targets of a prune set: rows suppressed by the policy hash that is ready.

    policy: profile_id, hash, refresh_state, refreshed_hash; a profile whose refresh
    isn't ready for its hash gives no targets.
    """
    ready = policy.filter((F.col("refresh_state") == "ready") & (F.col("refreshed_hash") == F.col("hash"))).select("profile_id", F.col("hash").alias("policy_hash"))
    rows = ledger.filter("state = 'suppressed'").join(ready, "profile_id").filter(F.col("suppressed_policy_hash") == F.col("policy_hash"))
    return rows.select("profile_id", "rel_path", "policy_hash", F.lit("pending").alias("target_state"))


def record_outcomes(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Targets with outcomes (deleted, missing, failed) joined to those that aren't final; ``changed`` marks transitions."""
    o = outcomes.groupBy(*KEY).agg(F.max("outcome").alias("outcome"))
    j = targets.join(o, KEY, "left")
    move = ~F.col("target_state").isin("deleted", "missing") & F.col("outcome").isNotNull()
    return j.withColumn("changed", F.coalesce(move & (F.col("outcome") != F.col("target_state")), F.lit(False))).withColumn("target_state", F.when(move, F.col("outcome")).otherwise(F.col("target_state"))).drop("outcome")


def outcome_counts(recorded: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("changed") & (F.col("target_state") == s)).alias(s)
    return recorded.groupBy("profile_id").agg(n("deleted"), n("missing"), n("failed"))


def complete_prune(ledger: DataFrame, recorded: DataFrame) -> DataFrame:
    """The ledger without suppressed rows whose targets are deleted or missing."""
    gone = recorded.filter(F.col("target_state").isin("deleted", "missing")).select(*KEY)
    return ledger.filter("state <> 'suppressed'").unionByName(ledger.filter("state = 'suppressed'").join(gone, KEY, "left_anti"))


def stale_requests(requests: DataFrame, targets: DataFrame, current: DataFrame) -> DataFrame:
    """Open requests whose policy hash is no longer current, or that name a reserved path, become stale."""
    bad = targets.filter(P.is_reserved("rel_path")).select("request_id").distinct().withColumn("reserved", F.lit(True))
    now = current.select("profile_id", F.col("hash").alias("current_hash"))
    j = requests.join(now, "profile_id", "left").join(bad, "request_id", "left")
    old = F.col("state").isin(*OPEN_REQUESTS) & (~F.col("policy_hash").eqNullSafe(F.col("current_hash")) | F.coalesce("reserved", F.lit(False)))
    return j.withColumn("state", F.when(old, "stale").otherwise(F.col("state"))).drop("current_hash", "reserved")


def newest_open(requests: DataFrame, order: str = "created_at") -> DataFrame:
    w = Window.partitionBy("profile_id").orderBy(F.col(order).desc(), F.col("request_id").desc())
    return requests.filter(F.col("state").isin(*OPEN_REQUESTS)).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def batched(targets: DataFrame, key: str = "profile_id", size: int = BATCH) -> DataFrame:
    return numbered(targets, key, "rel_path", "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def running_progress(results: DataFrame) -> DataFrame:
    """Completed and remaining targets after each result, in result order."""
    done = F.when(F.col("target_state").isin("deleted", "missing"), 1).otherwise(0)
    all_ = results.groupBy(F.col("profile_id").alias("__profile")).agg(F.count("*").alias("__all"))
    rows = Blocks(results, "profile_id", "seq").scan(sums={"completed": done}).done()
    rows = rows.join(all_, F.col("profile_id").eqNullSafe(F.col("__profile")))
    return rows.withColumn("remaining", F.col("__all") - F.col("completed")).drop("__profile", "__all")


def target_folders(targets: DataFrame) -> DataFrame:
    """Distinct folders above the targets with their depth; emptied deepest first at the sink."""
    up = targets.select("profile_id", F.explode(P.ancestor_list("rel_path")).alias("folder")).distinct()
    return up.withColumn("depth", P.depth("folder"))


def deepest_first(folders: DataFrame) -> DataFrame:
    return folders.orderBy(F.col("depth").desc(), "folder")


def fold_runs(runs: DataFrame) -> DataFrame:
    """Per-profile state from run history: profile_id, seq, status, target_generation, completed_at, error_code.

    Runs that still read ``running`` were interrupted: failed and retryable.
    """
    status = F.when(F.col("status") == "running", "failed").otherwise(F.col("status"))
    code = F.when(F.col("status") == "running", "worker_interrupted").otherwise(F.col("error_code"))
    r = runs.withColumns({"error_code": code, "status": status})
    ok = F.col("status") == "succeeded"
    g = r.groupBy("profile_id").agg(
        F.max(F.when(ok, F.col("target_generation"))).alias("last_success_generation"),
        F.min(F.when(ok, F.col("completed_at"))).alias("initialized_at"),
        F.max(F.when(ok, F.col("completed_at"))).alias("last_success_at"),
        F.max("target_generation").alias("desired_generation"),
        F.max_by(F.struct("status", "error_code"), "seq").alias("last"),
    )
    state = F.when(F.col("last.status") == "failed", "error").when(F.col("last_success_generation").isNull(), "initializing").when(F.col("desired_generation") > F.col("last_success_generation"), "syncing").otherwise("ready")
    return g.select("profile_id", "last_success_generation", "initialized_at", "last_success_at", "desired_generation", F.when(F.col("last.status") == "failed", F.col("last.error_code")).alias("last_error_code"), state.alias("state"))


def has_debt(desired: Column, last: Column) -> Column:
    return F.coalesce((desired > 0) & (last.isNull() | (desired > last)), F.lit(False))
