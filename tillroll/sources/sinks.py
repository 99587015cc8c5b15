"""Writers: clean table, KPI document, run log, run metadata, artifact list.

The clean table is rebalanced by month before the write: adaptive execution
puts small months together and splits a month that is larger than the
advisory partition size over several tasks, by the ranges of map output it
has, so neither a hot month nor a block of identical copies lands in one
task, and a retried task writes the same rows.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schema import ALIASES, to_source_headers
from tillroll.sources.jsonlog import MANY_RUNS, read_records

LOG_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)
ARTIFACT_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("produced_by", T.StringType()),
        T.StructField("artifact_type", T.StringType()),
    ]
)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", source_headers: bool = False) -> None:
    """The clean table, one folder per month.

    ``source_headers`` writes the original header names (``Invoice``,
    ``Customer ID``, ...) for readers that expect the source layout.
    """
    ordered = df.hint("rebalance", "year_month")
    month = "year_month"
    if source_headers:
        ordered = to_source_headers(ordered)
        month = ALIASES["year_month"][0]
    writer = ordered.write.mode("overwrite").partitionBy(month)
    if fmt == "csv":
        # Timestamps as pandas writes them, so pandas and this reader parse them back.
        writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    else:
        writer.parquet(path)


def write_document(doc_json: DataFrame, path: str) -> None:
    """The one-row JSON document as a single text file."""
    doc_json.coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small document as a single text file."""
    write_document(spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "document string"), path)


def _now() -> str:
    return dt.datetime.now().isoformat()


def append_records(records: DataFrame, base: str, kind: str = "tool_calls.jsonl", run_id: str | None = None) -> None:
    """Append log records, one JSON line each.

    ``records`` holds the record's fields; those with nested values are structs
    or variants. With ``run_id`` they all go to that run's folder. Otherwise
    the records name their runs in ``run_id`` and go to one folder for many
    runs, as many files as the records have tasks: a folder for each of very
    many runs would be a file for each of them in every append.
    """
    if run_id is None and "run_id" not in records.columns:
        raise ValueError("records of many runs must have a column run_id")
    records.write.mode("append").json(f"{base.rstrip('/')}/{run_id or MANY_RUNS}/{kind}")


def append_log(spark: SparkSession, base: str, run_id: str, tool: str, data: dict) -> None:
    """S7 for one step: append a tool-call record ``{timestamp, run_id, tool, data}`` to the run's log.

    ``data`` is a small dict of step figures (counts, paths), never lines.
    """
    row = (_now(), run_id, tool, json.dumps(data, ensure_ascii=False, default=str))
    frame = spark.createDataFrame([row], LOG_RECORD_SCHEMA).withColumn("data", F.parse_json("data"))
    append_records(frame.coalesce(1), base, run_id=run_id)


def append_decision(spark: SparkSession, base: str, run_id: str, agent: str, decision: str, reason: str) -> None:
    row = (_now(), agent, decision, reason)
    spark.createDataFrame([row], "timestamp string, agent string, decision string, reason string").coalesce(1).write.mode(
        "append"
    ).json(f"{base.rstrip('/')}/{run_id}/decisions.jsonl")


def write_metadata(spark: SparkSession, base: str, run_id: str, status: str, completed: list[str],
                   pending: list[str], artifacts: dict[str, str], errors: list[str]) -> None:
    """Run metadata (one record) as ``<base>/<run_id>/metadata.json``."""
    row = (run_id, status, completed, pending, artifacts, errors, "", _now())
    schema = ("run_id string, status string, completed array<string>, pending array<string>, "
              "artifacts map<string,string>, errors array<string>, current_step string, finished_at string")
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{base.rstrip('/')}/{run_id}/metadata.json")


def append_artifact_rows(artifacts: DataFrame, base: str, run_id: str | None = None) -> None:
    """Append artifact records {name, path, produced_by, artifact_type}, of one run or of the runs in column ``run_id``."""
    columns = [*ARTIFACT_SCHEMA.names, *([] if run_id is not None else ["run_id"])]
    append_records(artifacts.select(*columns), base, "artifacts.json", run_id)


def append_artifacts(spark: SparkSession, base: str, run_id: str, rows: list[tuple[str, str, str, str]]) -> None:
    """S9 for one step: a few artifact records."""
    append_artifact_rows(spark.createDataFrame(rows, ARTIFACT_SCHEMA).coalesce(1), base, run_id)


def read_artifacts(spark: SparkSession, base: str) -> DataFrame:
    """The artifact records of all runs under ``base``, with their run as ``run``."""
    return read_records(spark, base, "artifacts.json", ARTIFACT_SCHEMA)
