"""Run-log jobs against plain Python loops over the smallest events table."""

from collections import defaultdict

import pytest

from tillroll.operators import runlog as RL
from tillroll.sources.log_view import AGENTS, GRANTS, TOOLS, grants_frame, log_from_events


@pytest.fixture(scope="module")
def log_rows(spark, small_dir):
    log = log_from_events(spark, small_dir)
    return log, [r.asDict() for r in log.collect()]


def test_log_view_mapping(log_rows):
    _, rows = log_rows
    for r in rows[:200]:
        assert r["agent"] == AGENTS[r["event_id"] % 5] and r["tool"] == TOOLS[r["event_id"] % 4]
        assert r["run_id"] == f"r_{r['session'][2:]}_{r['ts'].day}"


def test_triage_matches_running_count(log_rows):
    log, rows = log_rows
    failures = sorted((r for r in rows if not r["success"]), key=lambda r: (r["ts"], r["event_id"]))
    seen = defaultdict(int)
    want = {}
    for r in failures:
        key = (r["session"], r["tool"])
        want[r["event_id"]] = "retry" if seen[key] < 2 else "skip"
        seen[key] += 1
    got = {r.event_id: r.action for r in RL.failure_triage(log, group="session").collect()}
    assert got == want
    assert set(want.values()) == {"retry", "skip"}


def test_permissions_match_lookup(spark, log_rows):
    log, rows = log_rows

    def allowed(agent, tool):
        perms = GRANTS.get(agent, [])
        return "*" in perms or tool in perms

    want_bad = {r["event_id"] for r in rows if not allowed(r["agent"], r["tool"])}
    got_bad = {r.event_id for r in RL.unauthorized_calls(log, grants_frame(spark)).collect()}
    got_ok = {r.event_id for r in RL.allowed_calls(log, grants_frame(spark)).collect()}
    assert got_bad == want_bad and got_ok == {r["event_id"] for r in rows} - want_bad


def test_decision_tail_is_last_twenty(log_rows):
    log, rows = log_rows
    by = defaultdict(list)
    for r in rows:
        by[r["session"]].append(r)
    want = set()
    for sess, rs in by.items():
        rs.sort(key=lambda r: (r["ts"], r["event_id"]))
        want |= {(sess, r["ts"].strftime("%Y-%m-%dT%H:%M:%S")) for r in rs[-20:]}
    got = {(r.session, r.timestamp) for r in RL.decision_tail(log, group="session").collect()}
    assert got == want


def test_run_status(log_rows):
    log, rows = log_rows
    failed = defaultdict(bool)
    for r in rows:
        failed[r["run_id"]] |= not r["success"]
    got = {r.run_id: r.status for r in RL.run_status(log).collect()}
    assert got == {k: ("failed" if v else "completed") for k, v in failed.items()}
