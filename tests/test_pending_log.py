"""The log of pending rows against a fold of all batches."""

import datetime as dt
import random

import pytest

from corpusgraph.streaming.pending_log import FAN, PendingLog

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "profile_id string, path string, event_kind string, first_seen timestamp, last_seen timestamp, source_generation long"
CLEARED = "profile_id string, path string, source_generation long"


def fold(state, events, cleared):
    done = {}
    for p, f, g in cleared:
        done[p, f] = max(g, done.get((p, f), 0))
    for k, g in done.items():
        if k in state and state[k][3] <= g:
            del state[k]
    for p, f, kind, first, last, g in events:
        old = state.get((p, f))
        newer = old is None or (g, last) >= (old[3], old[2])
        state[p, f] = (kind if newer else old[0], min(first, old[1]) if old else first, max(last, old[2]) if old else last, max(g, old[3]) if old else g)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_fold(spark, tmp_path, seed):
    rng, log, state, gen = random.Random(seed), PendingLog(spark, str(tmp_path)), {}, 0
    assert log.read().count() == 0
    for batch in range(2 * FAN + 3):
        events, cleared = [], []
        for k in list(state):
            if rng.random() < 0.3:
                cleared.append((*k, state[k][3] - (rng.random() < 0.3)))
        if rng.random() < 0.3:
            cleared.append(("p0", "never.md", 5))
        for _ in range(rng.randrange(6)):
            gen += 1
            t = T0 + dt.timedelta(seconds=gen)
            events.append((f"p{rng.randrange(2)}", f"f{rng.randrange(4)}.md", rng.choice(("modify", "delete")), t, t, gen))
        args = (spark.createDataFrame(events, SCHEMA), spark.createDataFrame(cleared, CLEARED))
        assert log.append(batch, *args)
        log.append(batch, *args)  # a replay
        if batch % 5 == 4 or batch == FAN:
            log.merge()
        fold(state, events, cleared)
        if batch % 6 == 5:
            assert {(r[0], r[1]): tuple(r)[2:6] for r in log.read().collect()} == state
    log.merge()
    before = sorted(map(str, log.read().collect()))
    assert {(r[0], r[1]): tuple(r)[2:6] for r in log.read().collect()} == state and len(log.runs()) < FAN
    assert not log.append(1, *args)  # merged already
    assert log.vacuum() == 2 * FAN and sorted(map(str, log.read().collect())) == before


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    log = PendingLog(spark, str(tmp_path))
    rows = [("p", f"f{i}.md", "modify", T0, T0, i) for i in range(500)]
    log.append(0, spark.createDataFrame(rows, SCHEMA))
    log.append(1, spark.createDataFrame([("p", "f1.md", "delete", T0, T0, 900)], SCHEMA))
    assert spark.read.parquet(f"{tmp_path}/run-0-1-1").count() == 1 and log.read().count() == 500


def test_half_written_runs_are_passed_over(spark, tmp_path):
    log = PendingLog(spark, str(tmp_path))
    log.append(0, spark.createDataFrame([("p", "a.md", "modify", T0, T0, 1)], SCHEMA))
    (tmp_path / "run-1-0-7").mkdir()
    assert log.runs() == [(0, 0, 0)] and log.read().count() == 1
