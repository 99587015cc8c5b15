"""Live run status from tool-call logs as they are appended.

The reference serves "real-time" logs by re-reading each run's files on
request. Here a file stream picks up new tool-call records under
``<base>/*/tool_calls.jsonl`` and keeps one small state row per run (calls,
errors, first and last call), emitted in update mode. State grows with the
number of runs, not with calls. ``foreachBatch`` writes each micro-batch's
changed runs to ``<out>/epoch=<n>``, overwriting that folder on a retry, so a
replayed batch leaves the same files; readers take the newest epoch per run.
The stream's checkpoint lies beside them (``<out>/_checkpoint``), so a restart
goes on where the epochs end. Every ``COMPACT_EVERY`` epochs the newest state of
each run is written into one epoch and the older ones are deleted.

Two forms. :func:`start_run_status` keeps a row of state for every run for ever
and counts whatever comes. :func:`start_live_status` goes by event time, so its
state stays bounded however long the stream runs: a call counts for its run's
window of event time, a repeated record counts once while it can still come
(``delay``), and once the watermark has passed a window its state is dropped.
Calls later than that are not counted by the stream; their number is in its
progress, and :func:`missed_calls` finds them in the log itself.

A file stream sees new files, not lines appended to a file it has already
read. The log sink (``sources.sinks.append_log``) writes every record as a
new part file inside the run's ``tool_calls.jsonl`` folder, which the stream
picks up; a log kept as one growing file is read once, as it stood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.session import drop_scratch
from tillroll.operators.runlog import failed_call
from tillroll.sources.jsonlog import TOOL_CALL_SCHEMA, _run_of_path, unify_tool_calls

COMPACT_EVERY = 100
# How late a call or a repeated record may come, and the width of a run's windows of event time.
DELAY, WINDOW = "10 minutes", "1 hour"


def tool_call_stream(spark: SparkSession, base: str, max_files_per_trigger: int = 1000) -> DataFrame:
    raw = (
        spark.readStream.schema(TOOL_CALL_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(f"{base.rstrip('/')}/*/tool_calls.jsonl")
    )
    return unify_tool_calls(raw.withColumn("file_run", _run_of_path()))


def live_status_updates(calls: DataFrame, delay: str = DELAY, width: str = WINDOW) -> DataFrame:
    """L5 by event time: calls, errors, first and last call of each (run, window); repeated records count once.

    A repeated record has the same run and ``event_id`` (a hash of the record). Calls without a time can't be placed in event time and are left out.
    """
    timed = calls.withColumn("at", F.col("ts").cast("timestamp")).filter(F.col("at").isNotNull())
    once = timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "event_id"])
    agg = once.groupBy(F.window("at", width), "run_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(failed_call(calls)).alias("n_errors"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_call_at"),
    )
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "run_id", "n_calls", "n_errors", "started_at", "last_call_at")


def start_live_status(spark: SparkSession, base: str, out: str, delay: str = DELAY, width: str = WINDOW, checkpoint: str | None = None,
                      available_now: bool = False, compact_every: int = COMPACT_EVERY, max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Start the event-time stream; each epoch holds the (run, window) rows that changed."""
    updates = live_status_updates(tool_call_stream(spark, base, max_files_per_trigger), delay, width)
    return _start(spark, updates, ["run_id", "window_start"], out, checkpoint, available_now, compact_every)


def live_status(spark: SparkSession, out: str) -> DataFrame:
    """One row a run from the newest state of its windows, with its status."""
    windows = latest_status(spark, out, ["run_id", "window_start"])
    run = windows.groupBy("run_id").agg(
        F.sum("n_calls").alias("n_calls"), F.sum("n_errors").alias("n_errors"),
        F.min("started_at").alias("started_at"), F.max("last_call_at").alias("last_call_at"),
    )
    return run.withColumn("status", F.when(F.col("n_errors") > 0, F.lit("failed")).otherwise(F.lit("running")))


def late_calls(query: StreamingQuery) -> int:
    """How many calls the query's progress (the batches it still remembers) reports as dropped behind the watermark."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def missed_calls(calls: DataFrame, live: DataFrame) -> DataFrame:
    """(run_id, n_calls, n_counted): runs of which the log holds calls that the stream did not count (late ones).

    ``calls`` is the whole log as a batch; repeated records count once.
    """
    logged = calls.filter(F.col("ts").isNotNull()).groupBy("run_id", "event_id").agg(F.lit(1).alias("one"))
    logged = logged.groupBy("run_id").agg(F.count("one").alias("n_calls"))
    counted = live.select("run_id", F.col("n_calls").alias("n_counted"))
    both = logged.join(counted, "run_id", "left").select("run_id", "n_calls", F.coalesce("n_counted", F.lit(0).cast("bigint")).alias("n_counted"))
    return both.filter("n_calls > n_counted")


def run_status_updates(calls: DataFrame) -> DataFrame:
    """L5 as a streaming aggregate: failed if any call failed so far."""
    agg = calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(failed_call(calls)).alias("n_errors"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_call_at"),
    )
    return agg.withColumn("status", F.when(F.col("n_errors") > 0, F.lit("failed")).otherwise(F.lit("running")))


def start_run_status(spark: SparkSession, base: str, out: str, checkpoint: str | None = None,
                     available_now: bool = False, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    return _start(spark, run_status_updates(tool_call_stream(spark, base)), ["run_id"], out, checkpoint, available_now, compact_every)


def _start(spark: SparkSession, updates: DataFrame, keys: list[str], out: str, checkpoint: str | None, available_now: bool,
           compact_every: int) -> StreamingQuery:
    out = out.rstrip("/")
    checkpoint = checkpoint or f"{out}/_checkpoint"

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if epoch % compact_every == compact_every - 1:
            compact_status(spark, out, epoch, keys)

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def compact_status(spark: SparkSession, out: str, epoch: int, keys: list[str] = ["run_id"]) -> None:
    """Newest state of each key into ``epoch``, the last one written; older epochs go."""
    out = out.rstrip("/")
    older = [r["epoch"] for r in spark.read.parquet(out).select("epoch").distinct().collect() if r["epoch"] < epoch]
    aside = f"{out}/_compacted"
    latest_status(spark, out, keys).write.mode("overwrite").parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    for e in older:
        drop_scratch(spark, f"{out}/epoch={e}")
    drop_scratch(spark, aside)


def latest_status(spark: SparkSession, out: str, keys: list[str] = ["run_id"]) -> DataFrame:
    """Newest state of each key (a run, or a run's window) across the written epochs."""
    hist = spark.read.parquet(out)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("epoch").desc()))
    return hist.withColumn("_rn", newest).filter(F.col("_rn") == 1).drop("_rn", "epoch")
