"""The stream of job states: deadlines, batches and restarts."""

from __future__ import annotations

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.streaming import jobs


def test_deadlines():
    assert jobs.transitions(("running", 0, 1, 0), 10, 10, 5) == (("running", 0, 1, 0), [])
    assert jobs.transitions(("running", 0, 1, 0), 11, 10, 5) == (("queued", 10, 1, 1), [("requeued", 10, 1)])
    state, found = jobs.transitions(("queued", 0, 1, 0), 10**9, 10, 5)
    assert state is None and found == [("requeued", 10, 1), ("requeued", 20, 2), ("requeued", 30, 3), ("failed", 40, 3), ("expired", 45, 3)]
    assert jobs.transitions(("completed", 7, 1, 0), 13, 10, 5) == (None, [("expired", 12, 0)]) and jobs.transitions(None, 5, 1, 1) == (None, [])


@given(st.lists(st.integers(0, 300), max_size=6), st.integers(1, 40), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_deadlines_may_be_passed_in_steps(cuts, lease, live):
    """The same happens however often it is looked at."""
    whole = jobs.transitions(("running", 0, 1, 0), 300, lease, live)
    state, found = ("running", 0, 1, 0), []
    for cut in [*sorted(cuts), 300]:
        state, more = jobs.transitions(state, cut, lease, live)
        found += more
    assert (state, found) == whole


def brute(events, lease, live):
    mark, out = max(at for *_, at in events), []
    for job in {e[0] for e in events}:
        own = sorted((at, number, status) for j, number, status, at in events if j == job)
        for k, (at, number, status) in enumerate(own):
            until = min(own[k + 1][0] if k + 1 < len(own) else mark, mark)
            out += [(job, *t) for t in jobs.transitions((status, at, number, 0), until, lease, live)[1]]
    return sorted(out)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Events come in four files; the stream ends after each and starts again."""
    pick = random.Random(5)
    start = 1_700_000_000_000
    times = sorted(pick.sample(range(0, 400_000), 80))
    events = [(pick.randrange(7), n, pick.choice(["queued", "running", "completed", "failed", "skipped"]), start + t) for n, t in enumerate(times)]
    shape = "job_id long, number long, status string, ts timestamp"
    seen = 0
    for part in range(4):
        rows = [(j, n, s, dt.datetime.fromtimestamp(at / 1000, dt.timezone.utc)) for j, n, s, at in events[part * 20 : part * 20 + 20]]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        jobs.watch(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 9_000, 4_000).awaitTermination()
        found = sorted(tuple(r) for r in spark.read.schema(jobs.TRANSITION).parquet(str(tmp_path / "out")).collect())
        assert found == brute(events[: part * 20 + 20], 9_000, 4_000)
        assert len(found) >= seen
        seen = len(found)
    assert {k for _, k, *_ in found} == {"requeued", "failed", "expired"}
