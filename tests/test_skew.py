"""Hot keys: one session, one invoice or one group of copies holding a third of all rows.

Results must not change when a key is hot. Broadcasts are off and AQE skew
thresholds are tiny, so the sort-merge and skew-split paths run.
"""

import datetime as dt
from collections import defaultdict

import pandas as pd
import pytest

from frames import raw_frame
from tillroll.operators import kpis as KP
from tillroll.operators import quality as QU
from tillroll.operators import runlog as RL

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}
N = 3000


@pytest.fixture(scope="module")
def hot(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _log_rows():
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(N):
        session = "s_hot" if i % 3 == 0 else f"s_{i % 97}"
        rows.append((i, t0 + dt.timedelta(seconds=i // 2), session, f"r_{session}", "bi_agent",
                     ["clean_data", "run_analysis"][i % 2], (i * 7) % 5 != 0, "error" if (i * 7) % 5 == 0 else "view",
                     f"p{i}"))
    return rows


def test_triage_and_tail_with_a_hot_session(hot):
    rows = _log_rows()
    log = hot.createDataFrame(rows, "event_id long, ts timestamp_ntz, session string, run_id string, agent string, "
                                    "tool string, success boolean, event_type string, props string")
    seen, want = defaultdict(int), {}
    for r in sorted((r for r in rows if not r[6]), key=lambda r: (r[1], r[0])):
        want[r[0]] = "retry" if seen[(r[2], r[5])] < 2 else "skip"
        seen[(r[2], r[5])] += 1
    got = {r.event_id: r.action for r in RL.failure_triage(log, group="session").collect()}
    assert got == want
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    want_tail = {(s, r[0]) for s, rs in by.items() for r in sorted(rs, key=lambda r: (r[1], r[0]))[-20:]}
    tail = RL.decision_tail(log, group="session").select("session", "recency", "reason").collect()
    assert {(r.session, int(r.reason[1:])) for r in tail} == want_tail


def test_duplicates_and_kpis_with_hot_keys(hot):
    base = dt.datetime(2010, 1, 1)
    rows = [("HOT", "A", "mug", 1, base, 1.5, 7.0, "UK")] * (N // 3)            # one group of copies
    rows += [("BIG", "B", f"item{i % 50}", 1 + i % 3, base, 2.0 + i % 7, 8.0, "FR") for i in range(N // 3)]  # one hot invoice
    rows += [(str(i), "C", f"item{i % 50}", 1, base + dt.timedelta(days=i % 60), 1.0, float(i % 40), "DE") for i in range(N // 3)]
    df = raw_frame(hot, rows)
    pdf = pd.DataFrame(rows, columns=df.columns)
    assert QU.duplicate_count(df).collect()[0].duplicate_rows == int(pdf.duplicated().sum())
    k = KP.kpi_scalars(df).collect()[0]
    sales = pdf["quantity"] * pdf["price"]
    assert k.ca_total == pytest.approx(round(float(sales.sum()), 2), abs=1e-6)
    assert k.n_orders == pdf["invoice"].nunique() and k.n_customers == pdf["customer_id"].nunique()
    assert k.avg_basket == pytest.approx(round(float(sales.groupby(pdf["invoice"]).sum().mean()), 2), abs=0.005)
    top = KP.top_countries(df).orderBy("rank").collect()
    want = pdf.assign(s=sales).groupby("country")["s"].sum().sort_values(ascending=False)
    assert [r.country for r in top] == list(want.index)


def test_duplicates_tell_nulls_apart(hot):
    """Nulls in other columns, NaN, -0.0 and large groups of copies; the row count comes from the same pass."""
    base = dt.datetime(2010, 1, 1)
    rows = [("HOT", "A", "mug", 1, base, 1.5, 7.0, "UK")] * 1000 + [
        (str(i % 700), "B", None, 1, base, 2.0, None, "FR") for i in range(2000)]
    rows += [(None, "A", "x", 1, base, 1.0, 1.0, "UK"), ("A", None, "x", 1, base, 1.0, 1.0, "UK")]
    rows += [("n", "A", "x", 1, base, 0.0, 1.0, "UK"), ("n", "A", "x", 1, base, -0.0, 1.0, "UK")]
    rows += [("m", "A", "x", 1, base, float("nan"), 1.0, "UK")] * 2
    r = QU.duplicate_count(raw_frame(hot, rows)).collect()[0]
    # 999 copies, 1300 repeats of 700 rows, one pair of zeros, one pair of NaN.
    assert (r.n_rows, r.duplicate_rows) == (len(rows), 999 + 1300 + 1 + 1)


def test_hot_session_is_split_by_adaptive_execution(spark):
    """The triage join gets fresh shuffles on both sides, so AQE splits the hot session."""
    conf = {**CONF, "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        t0 = dt.datetime(2024, 1, 1)
        rows = [(i, t0 + dt.timedelta(seconds=i), "s_hot" if i % 3 == 0 else f"s_{i % 500}", "r", "bi_agent",
                 "clean_data", False, "error", "p" * 50) for i in range(60000)]
        log = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, session string, run_id string, "
                                          "agent string, tool string, success boolean, event_type string, props string")
        df = RL.failure_triage(log, group="session")
        got = df.collect()
        assert sum(r.action == "retry" for r in got) == 2 * 501       # two retries per session
        assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
