"""The run log as a table, and the agent/tool grants.

``log_from_events`` maps the driver's ``events`` table onto the tool-call
log layout: a session per user, a run per user and day, an agent and a tool
by event id, success unless the event is an error. Ties in ``ts`` are
broken by ``event_id`` wherever order matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.tables import read_table

# Agent and tool names by position (event_id modulo count).
AGENTS = ["data_engineer", "data_scientist", "bi_agent", "reporter", "orchestrator"]
TOOLS = ["clean_data", "run_analysis", "generate_chart", "log_artifact"]

# Tools granted to each agent; "*" grants every tool.
GRANTS = {
    "orchestrator": ["*"],
    "data_quality": ["load_dataset", "quality_check", "log_artifact"],
    "data_engineer": ["load_dataset", "profile_data", "clean_data", "log_artifact"],
    "data_scientist": ["run_analysis", "log_artifact"],
    "bi_agent": ["generate_chart", "publish_dashboard", "log_artifact"],
    "reporter": ["compile_report", "log_artifact"],
    "devops": ["log_artifact"],
}
ALL_TOOLS = "*"


def log_from_events(spark: SparkSession, data_dir: str) -> DataFrame:
    ev = read_table(spark, data_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    user = F.col("user_id").cast("string")
    agents = F.array(*[F.lit(a) for a in AGENTS])
    tools = F.array(*[F.lit(t) for t in TOOLS])
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("s_"), user).alias("session"),
        F.concat(F.lit("r_"), user, F.lit("_"), F.dayofmonth("ts").cast("string")).alias("run_id"),
        F.get(agents, (F.col("event_id") % len(AGENTS)).cast("int")).alias("agent"),
        F.get(tools, (F.col("event_id") % len(TOOLS)).cast("int")).alias("tool"),
        (F.col("event_type") != "error").alias("success"),
        # Failed: not known to have succeeded. In this form the filter reaches the scan.
        ((F.col("event_type") == "error") | F.col("event_type").isNull()).alias("failed"),
        "event_type",
        "props",
    )


def grants_frame(spark: SparkSession) -> DataFrame:
    rows = [(agent, tool) for agent, tools in GRANTS.items() for tool in tools]
    return spark.createDataFrame(rows, "agent string, tool string")
