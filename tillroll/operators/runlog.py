"""Queries over the run log: status, history, permissions, failure triage, decisions.

Input is a log table with ``event_id, ts, run_id, agent, tool, success``
(see ``sources.log_view``); ``event_type`` and ``props`` supply decision and
error text. One run may hold a large share of all calls, so nothing here
puts a whole run into one task: per-run figures are partial aggregates, the
decision tail is a row-number limit that Spark applies per task before the
shuffle, and failure triage needs only the second failure of each run and
step (a group limit of 2), joined back to the failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.timejoins import asof_join, interval_join
from tillroll.sources.log_view import ALL_TOOLS

# Triage decisions and their reasons.
RETRY, SKIP = "retry", "skip"
RETRY_REASON = "Première/deuxième tentative sur "
SKIP_REASON_HEAD, SKIP_REASON_TAIL = "Trop d'échecs sur ", ", on continue sans"
FAILED, COMPLETED = "failed", "completed"
MAX_RETRIES = 2
TAIL = 20
TS_CHARS, REASON_CHARS = 19, 80


def tool_calls(log: DataFrame) -> DataFrame:
    """One row per call with success and error text."""
    error = F.when(failed_call(log), F.col("props"))
    return log.select("event_id", "ts", "run_id", "agent", "tool", "success", error.alias("error"))


def _granted(log: DataFrame, grants: DataFrame, how: str) -> DataFrame:
    g = F.broadcast(grants.select(F.col("agent").alias("g_agent"), F.col("tool").alias("g_tool")))
    cond = (F.col("agent") == F.col("g_agent")) & ((F.col("g_tool") == F.lit(ALL_TOOLS)) | (F.col("g_tool") == F.col("tool")))
    return log.join(g, cond, how).select("event_id", "ts", "run_id", "agent", "tool")


def unauthorized_calls(log: DataFrame, grants: DataFrame) -> DataFrame:
    """L2: calls whose (agent, tool) is not granted. ``grants`` is a fixed small list."""
    return _granted(log, grants, "left_anti")


def allowed_calls(log: DataFrame, grants: DataFrame) -> DataFrame:
    """L3: calls whose (agent, tool) is granted."""
    return _granted(log, grants, "left_semi")


def failed_call(log: DataFrame) -> Column:
    """A call that is not known to have succeeded (the log's own ``failed``, if it has one, can be pushed to the scan)."""
    return F.col("failed") if "failed" in log.columns else ~F.col("success") | F.col("success").isNull()


def _failures(log: DataFrame, group: str) -> DataFrame:
    return log.filter(failed_call(log)).select("event_id", "ts", group, F.col("tool").alias("step"))


def second_failures(log: DataFrame, group: str = "run_id") -> DataFrame:
    """The second failure (ts, id) of each (group, step); a group limit of 2 before the shuffle."""
    order = Window.partitionBy(group, "step").orderBy("ts", "event_id")
    return (
        _failures(log, group).withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= MAX_RETRIES)
        .filter(F.col("_rn") == MAX_RETRIES)
        .select(group, "step", F.col("ts").alias("ts2"), F.col("event_id").alias("id2"))
    )


def failure_triage(log: DataFrame, group: str = "run_id") -> DataFrame:
    """L4: per failed call, retry while fewer than 2 earlier failures of the same group and step.

    ``group`` is the log unit the retries are counted in (a run, or a session).

    A failure has fewer than two earlier failures exactly when it is not
    after the second failure of its (run, step). ``row_number() <= 2`` is a
    group limit Spark applies inside each task before the shuffle, so even a
    run holding most failures sends only two rows per task onward.

    The second-failure table (one row per group and step) gets a computed
    group key for the join: it does not carry the window's partitioning over,
    so the join shuffles both sides afresh and AQE can split a hot group
    across tasks, or broadcast the table where it is measured to be small.
    """
    failures = _failures(log, group)
    second = second_failures(log, group)
    second = second.withColumn(group, F.concat(F.col(group), F.lit("")))
    joined = failures.join(second, [group, "step"], "left")
    before_second = (F.col("ts") < F.col("ts2")) | ((F.col("ts") == F.col("ts2")) & (F.col("event_id") <= F.col("id2")))
    retry = F.col("ts2").isNull() | before_second
    action = F.when(retry, F.lit(RETRY)).otherwise(F.lit(SKIP))
    reason = F.when(retry, F.concat(F.lit(RETRY_REASON), F.col("step"))).otherwise(
        F.concat(F.lit(SKIP_REASON_HEAD), F.col("step"), F.lit(SKIP_REASON_TAIL))
    )
    return joined.select("event_id", "ts", group, "step", action.alias("action"), reason.alias("reason"))


def run_status(log: DataFrame) -> DataFrame:
    """Failed if any call failed, else completed."""
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(failed_call(log)).alias("n_errors"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
    ).select(
        "run_id",
        F.when(F.col("n_errors") > 0, F.lit(FAILED)).otherwise(F.lit(COMPLETED)).alias("status"),
        "n_calls",
        "n_errors",
        "started_at",
        "finished_at",
    )


def run_history(log: DataFrame) -> DataFrame:
    """L1: runs, newest run id first (a range-partitioned sort, not one task)."""
    return run_status(log).orderBy(F.col("run_id").desc())


def decision_tail(log: DataFrame, n: int = TAIL, group: str = "run_id") -> DataFrame:
    """R2: the last ``n`` decisions of each ``group`` (run or session); ``recency`` 1 is the newest.

    Timestamp text is cut to 19 characters, the reason to 80.
    """
    order = Window.partitionBy(group).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (
        log.withColumn("recency", F.row_number().over(order))
        .filter(F.col("recency") <= n)
        .select(
            group,
            "recency",
            F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 1, TS_CHARS).alias("timestamp"),
            "agent",
            F.col("event_type").alias("decision"),
            F.substring(F.coalesce(F.col("props"), F.lit("")), 1, REASON_CHARS).alias("reason"),
        )
    )


def run_report(log: DataFrame, n: int = TAIL) -> DataFrame:
    """Per run, status and counts joined with the triage decisions (left join on run).

    ``n_decisions_shown`` is the tail of at most ``n`` of the run's decisions.
    """
    status = run_status(log)
    triage = failure_triage(log).groupBy("run_id").agg(
        F.count_if(F.col("action") == RETRY).alias("n_retries"),
        F.count_if(F.col("action") == SKIP).alias("n_skips"),
    )
    return status.join(triage, "run_id", "left").select(
        "run_id",
        "status",
        "n_calls",
        "n_errors",
        F.least(F.coalesce(F.col("n_retries") + F.col("n_skips"), F.lit(0)), F.lit(n)).alias("n_decisions_shown"),
        F.coalesce(F.col("n_retries"), F.lit(0)).alias("n_retries"),
        F.coalesce(F.col("n_skips"), F.lit(0)).alias("n_skips"),
    )


def decisions_before_failures(log: DataFrame, group: str = "session") -> DataFrame:
    """R2/L4: each failed call with the last decision of its group at or before it (an as-of join).

    Decisions are the records that did not fail; of equal times the largest
    id is the last. A call without an earlier decision keeps nulls.
    """
    failures = log.filter(failed_call(log)).select("event_id", "ts", group, F.col("tool").alias("step"))
    decisions = log.filter("success").select(group, "ts", "event_id", "agent", F.col("event_type").alias("decision"))
    joined = asof_join(failures, decisions, [group], "ts", ["event_id", "ts", "agent", "decision"], tie="event_id", prefix="last_")
    waited = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))).alias("waited_us")
    return joined.select("event_id", "ts", group, "step", "last_event_id", "last_agent", "last_decision", waited)


def calls_in_lifetime(log: DataFrame, group: str = "session", seconds: int = 86_400) -> DataFrame:
    """For each run, the calls of its group (its own and other runs') between its first and last call.

    (run_id, started_at, finished_at, n_calls, n_other_calls, n_errors): a
    range join of calls with lifetimes, counted by partial aggregates.
    """
    lifetimes = run_status(log).select("run_id", "started_at", "finished_at")
    of_group = log.groupBy("run_id", group).agg(F.lit(1).alias("one")).drop("one").join(lifetimes, "run_id")
    calls = log.select(group, "event_id", "ts", F.col("run_id").alias("call_run"), failed_call(log).alias("call_failed"))
    met = interval_join(calls, of_group, [group], "ts", "started_at", "finished_at", seconds)
    return met.groupBy("run_id", "started_at", "finished_at").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(F.col("call_run") != F.col("run_id")).alias("n_other_calls"),
        F.count_if("call_failed").alias("n_errors"),
    )
