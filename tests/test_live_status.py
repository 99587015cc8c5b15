"""The event-time stream of run status: late, repeated and expired calls, over restarts."""

import json
import os

import pytest

from tillroll.sources.jsonlog import read_tool_calls
from tillroll.streaming.run_status import late_calls, live_status, missed_calls, start_live_status


class Log:
    """A log folder that is appended to, and the stream started anew after each append."""

    def __init__(self, spark, base):
        self.spark, self.base, self.out, self.parts = spark, f"{base}/runs", f"{base}/status", 0

    def append(self, *calls):
        self.parts += 1
        folder = f"{self.base}/r/tool_calls.jsonl"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/part-{self.parts}.json", "w") as f:
            for run, stamp, error in calls:
                f.write(json.dumps({"timestamp": stamp, "run_id": run, "tool": "t", "error": error}) + "\n")
        self.query = start_live_status(self.spark, self.base, self.out, delay="10 minutes", width="1 hour", available_now=True, compact_every=3)
        self.query.awaitTermination(120)
        assert self.query.exception() is None
        return {r.run_id: (r.status, r.n_calls, r.n_errors) for r in live_status(self.spark, self.out).collect()}

    def state_rows(self):
        """State of the aggregate and of the repeated records after the last batch."""
        last = [p for p in self.query.recentProgress if p["stateOperators"]][-1]
        return {s["operatorName"]: s["numRowsTotal"] for s in last["stateOperators"]}


def day(clock):
    return f"2025-01-01T{clock}:00"


def test_late_repeated_and_expired_calls_over_restarts(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    assert log.append(("a", day("10:00"), None), ("b", day("10:05"), "boom")) == {"a": ("running", 1, 0), "b": ("failed", 1, 1)}
    # Repeated after a restart, within the delay: counts once. Out of order, within the delay: counts.
    assert log.append(("a", day("10:00"), None), ("a", day("09:57"), None))["a"] == ("running", 2, 0)
    # A run's calls in a later window add to its earlier ones; the watermark is 11:50 from now on.
    assert log.append(("a", day("12:00"), "late disk"))["a"] == ("failed", 3, 1)
    # Late by more than the delay: dropped, reported by the progress, and found in the log.
    got = log.append(("a", day("10:10"), None), ("c", day("10:20"), None), ("b", day("11:55"), None))
    assert got == {"a": ("failed", 3, 1), "b": ("failed", 2, 1)}
    assert late_calls(log.query) == 2
    missed = missed_calls(read_tool_calls(spark, log.base), live_status(spark, log.out))
    assert {(r.run_id, r.n_calls, r.n_counted) for r in missed.collect()} == {("a", 4, 3), ("c", 1, 0)}
    # Days later, all the old windows' state has gone, and the counts written are still there.
    log.append(("d", "2025-01-05T00:00:00", None))
    assert log.append(("d", "2025-01-05T00:01:00", None)) == {"a": ("failed", 3, 1), "b": ("failed", 2, 1), "d": ("running", 2, 0)}
    assert all(n <= 2 for n in log.state_rows().values())


def test_a_repeat_long_after_is_late_and_not_counted_twice(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.append(("a", day("10:00"), None))
    log.append(("a", day("15:00"), None))
    assert log.append(("a", day("10:00"), None)) == {"a": ("running", 2, 0)}
    assert late_calls(log.query) == 1
    assert missed_calls(read_tool_calls(spark, log.base), live_status(spark, log.out)).collect() == []


def test_calls_without_a_time_and_without_a_run(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    got = log.append(("a", "no time", None), ("a", None, None), (None, day("10:00"), None), ("a", day("10:00"), ""))
    assert got == {"a": ("running", 1, 0), "r": ("running", 1, 0)}  # a record without a run belongs to its folder's


@pytest.mark.parametrize("n", [1, 40])
def test_a_hot_run_is_one_row_a_window(spark, tmp_path, n):
    """Calls of one run are put together before they reach its state."""
    log = Log(spark, str(tmp_path))
    calls = [("hot", f"2025-01-01T10:{i % 60:02d}:{i // 60:02d}", "x" if i == 7 else None) for i in range(n * 25)]
    assert log.append(*calls)["hot"] == ("failed", n * 25, 1)
    assert len(live_status(spark, log.out).collect()) == 1
