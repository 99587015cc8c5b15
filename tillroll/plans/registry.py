"""Registered queries: one callable ``(spark, data_dir) -> DataFrame`` per key.

Inputs: raw invoice lines come from the star-schema view
(``sources.retail_view``), clean lines from the seven cleaning rules, and
the run log from ``events``; its sessions (one per user, each with more than
20 calls) carry the last-20 decision tail and the failure triage. KPIs that
are constant on clean lines by construction (cancellation, return and
completeness rates, and therefore the alerts) run on the raw lines;
everything else runs on the clean table, as the workflow does.

Results hand out decimals as doubles (``to_output``): money is exact up to
the final rounding, and doubles are what the JSON document and the oracle
comparison see.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators import alerts as AL
from tillroll.operators import clean as CL
from tillroll.operators import dashboard as DB
from tillroll.operators import document as DOC
from tillroll.operators import kpis as KP
from tillroll.operators import profile as PR
from tillroll.operators import quality as QU
from tillroll.operators import reconcile as RC
from tillroll.operators import report as RP
from tillroll.operators import runlog as RL
from tillroll.operators import sketches as SK
from tillroll.plans import inputs as I
from tillroll.schema import CLEAN_COLUMNS, to_source_headers
from tillroll.session import scratch_dir
from tillroll.sources import invoices as INV
from tillroll.sources import sinks
from tillroll.sources.csv import read_invoice_csv
from tillroll.sources.jsonlog import TOOL_CALL_SCHEMA, payload_fields, read_records, read_tool_calls
from tillroll.streaming.run_status import live_status, start_live_status


Query = Callable[[SparkSession, str], DataFrame]

# Fixed value: the date that splits the view into the two period files of ``union_periods``.
PERIOD_SPLIT = "1998-01-01"
# Fixed value: the delay within which the log of ``live_run_status`` comes, as its files have no order of time.
LIVE_DELAY = "3650 days"
# Fixed value: the name of all months together.
ALL_MONTHS = "all"
# The run that ``dashboard_payload`` is published for, and its folder.
PAYLOAD_RUN, PAYLOAD_PATH = "run_001", "runs/run_001/artifacts/dashboard"


def to_output(df: DataFrame) -> DataFrame:
    """Decimals out as doubles; other columns unchanged."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _insights(spark: SparkSession, d: str) -> DataFrame:
    return I.SmallTables(spark, d).insights


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


def _csv_lines(df: DataFrame) -> DataFrame:
    """Lines as text under their source headers, as an invoice file holds them."""
    return to_source_headers(df.withColumn("invoice_date", F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss")))


def _union_periods(spark: SparkSession, d: str) -> DataFrame:
    """Two period files written as CSV parts (a line without a date is in the second), read back and put together."""
    path = _scratch(spark, "periods")
    part = F.when(F.col("InvoiceDate") < PERIOD_SPLIT, F.lit("p1")).otherwise(F.lit("p2"))
    _csv_lines(I.raw(spark, d)).withColumn("part", part).write.partitionBy("part").option("header", True).csv(path)
    return INV.union_periods([(p, read_invoice_csv(spark, f"{path}/part={p}")) for p in ("p1", "p2")])


def _csv_scan(spark: SparkSession, d: str, encoding: str = "UTF-8") -> DataFrame:
    """The raw lines written as two sets of files with other headers and column orders, and read as one."""
    raw = I.raw(spark, d)
    path = _scratch(spark, "csv")
    first = F.coalesce(F.col("quantity") % 2 == 0, F.lit(False))  # a line without a quantity is in the second set
    lines = _csv_lines(raw.filter(first))
    lines.write.option("header", True).option("encoding", encoding).csv(f"{path}/a")
    other = _csv_lines(raw.filter(~first)).withColumnsRenamed({"Invoice": "InvoiceNo", "Price": "UnitPrice", "Customer ID": "CustomerID"})
    other.select(*reversed(other.columns)).write.option("header", True).option("encoding", encoding).csv(f"{path}/b")
    return read_invoice_csv(spark, [f"{path}/a", f"{path}/b"], encoding=encoding)


def _clean_sink(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "clean")
    sinks.write_clean(I.cleaned(spark, d), path)
    return spark.read.parquet(path).select(*CLEAN_COLUMNS)


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The run log appended as JSON lines, even events in one record shape and all others in the other, and read back."""
    log = I.log(spark, d)
    base = _scratch(spark, "runs")
    error = F.when(~F.col("success"), F.col("props"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    data = F.struct(F.when(F.col("success"), "success").otherwise("error").alias("status"), error.alias("message"), F.col("event_id"))
    even = F.coalesce(F.col("event_id") % 2 == 0, F.lit(False))
    short = log.filter(even).select(stamp.alias("timestamp"), "run_id", "tool", data.alias("data"))
    sinks.append_records(short, base)
    output = F.struct(F.col("event_id"), F.col("run_id"))
    long = log.filter(~even).select(
        stamp.alias("timestamp"), "run_id", F.col("agent").alias("agent_name"), F.col("tool").alias("tool_name"),
        F.struct(F.lit("x").alias("file_path")).alias("input"), output.alias("output"), "success", error.alias("error"),
    )
    sinks.append_records(long, base)
    calls = read_tool_calls(spark, base)
    event = F.get_json_object("payload", "$.event_id").cast("bigint")
    return calls.select(event.alias("event_id"), "ts", "run_id", "agent", "tool", "success", "error")


def _live_run_status(spark: SparkSession, d: str) -> DataFrame:
    """Run status by the event-time stream over the log as it was appended: every third record twice, in two parts."""
    log = I.log(spark, d)
    base = _scratch(spark, "live")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    error = F.when(F.col("failed"), F.lit("failed")).alias("error")
    records = log.select(stamp, "run_id", F.col("agent").alias("agent_name"), F.col("tool").alias("tool_name"), F.struct("event_id").alias("input"), error)
    sinks.append_records(records, base)
    sinks.append_records(records.filter(F.col("input.event_id") % 3 == 0), base)
    query = start_live_status(spark, base, f"{base}/status", delay=LIVE_DELAY, available_now=True)
    query.awaitTermination()
    status = live_status(spark, f"{base}/status")
    return status.select("run_id", "status", "n_calls", "n_errors", "started_at", "last_call_at")


def _payload_fields(spark: SparkSession, d: str) -> DataFrame:
    """The run log appended with nested payloads (every eleventh one broken), read back and opened."""
    log = I.log(spark, d)
    base = _scratch(spark, "payloads")
    nested = F.struct(
        F.col("event_type").alias("kind"), F.parse_json("props").alias("props"), F.array("agent", "tool").alias("by"),
        F.struct(F.col("success").alias("ok"), F.array().cast("array<string>").alias("none")).alias("state"),
    )
    broken = F.col("event_id") % 11 == 0
    data = F.when(broken, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(nested))
    records = log.select(
        "run_id", F.col("event_id").cast("string").alias("tool"), data.alias("data"),
        F.struct(F.col("event_id").alias("id")).alias("input"),
    )
    sinks.append_records(records, base)
    raw = read_records(spark, base, "tool_calls.jsonl", TOOL_CALL_SCHEMA)
    return payload_fields(raw.select(F.col("tool").cast("bigint").alias("event_id"), "input", "data"), ["input", "data"])


def _artifact_list(spark: SparkSession, d: str) -> DataFrame:
    """One artifact record for each run and tool of the log, appended and read back."""
    base = _scratch(spark, "artifacts")
    log = I.log(spark, d)
    rows = log.filter("success").groupBy("run_id", "tool").agg(F.min("agent").alias("produced_by")).select(
        "run_id", F.col("tool").alias("name"), F.concat_ws("/", "run_id", "tool").alias("path"), "produced_by",
        F.lit("table").alias("artifact_type"),
    )
    sinks.append_artifact_rows(rows, base)
    return sinks.read_artifacts(spark, base)


def _insights_raw(spark: SparkSession, d: str) -> DataFrame:
    return I.SmallTables(spark, d, I.raw(spark, d)).insights


def _dashboard_payload(spark: SparkSession, d: str) -> DataFrame:
    t = I.SmallTables(spark, d)
    payload = DOC.dashboard_payload(t.kpis, t.monthly, t.countries, t.products, t.alerts, t.insights, PAYLOAD_RUN, PAYLOAD_PATH)
    return DOC.payload_rows(payload)


def _kpi_document(spark: SparkSession, d: str) -> DataFrame:
    t = I.SmallTables(spark, d)
    return DOC.kpi_document(t.kpis, t.monthly, t.countries, t.products, t.alerts, t.insights)


def _headline_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = I.SmallTables(spark, d)
    return DB.headline_metrics(t.kpis, t.monthly, t.countries, t.alerts, t.insights)


def _chart_series(spark: SparkSession, d: str) -> DataFrame:
    t = I.SmallTables(spark, d, orders=False)
    return DB.chart_series(t.monthly, t.countries, t.products)


def _metric_cards(spark: SparkSession, d: str) -> DataFrame:
    t = I.SmallTables(spark, d)
    return DB.metric_cards(t.kpis, DB.month_over_month(t.monthly))


def _customer_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Exact customers of each month and of all months, and whether the merged sketches' estimates are within their error."""
    lines = KP.line_figures(I.cleaned(spark, d))
    sketches = SK.month_sketches(I.cleaned(spark, d))
    path = _scratch(spark, "sketches")
    sketches.write.parquet(path)  # kept by month: what is merged below needs no lines
    kept = spark.read.parquet(path)
    months = SK.estimates(kept, "estimate").unionByName(
        SK.merge(kept).select(F.lit(ALL_MONTHS).alias("year_month"), SK.estimate().alias("estimate"))
    )
    exact = lines.select("year_month", "customer_id").distinct().groupBy("year_month").agg(F.count("customer_id").alias("n_customers"))
    total = lines.agg(F.count_distinct("customer_id").alias("n_customers")).select(F.lit(ALL_MONTHS).alias("year_month"), "n_customers")
    both = months.join(exact.unionByName(total), "year_month")
    return both.select("year_month", "n_customers", SK.within(F.col("estimate"), F.col("n_customers")).alias("within_error"))


def _periods(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue lines (product, price, country) of the two periods of the view."""
    raw = I.raw(spark, d)
    first = F.coalesce(F.col("invoice_date") < PERIOD_SPLIT, F.lit(False))
    columns = ["stock_code", "description", "price", "country"]
    return raw.filter(first).select(*columns), raw.filter(~first).select(*columns)


QUERIES: dict[str, Query] = {
    # Sources
    "load_report": lambda s, d: INV.load_report(I.raw(s, d)),
    "load_preview": lambda s, d: INV.load_preview(I.raw(s, d), 3),
    "union_periods": _union_periods,
    "period_differences": lambda s, d: RC.differences(*_periods(s, d)),
    "period_summary": lambda s, d: RC.summary(*_periods(s, d)),
    "csv_scan": _csv_scan,
    "csv_scan_latin1": lambda s, d: _csv_scan(s, d, "ISO-8859-1"),
    # Profiling and quality
    "null_profile": lambda s, d: PR.null_profile(I.raw(s, d), digits=2, only_missing=True),
    "null_profile_all": lambda s, d: PR.null_profile(I.raw(s, d), digits=1, only_missing=False),
    "problem_counts": lambda s, d: PR.problem_counts(I.raw(s, d)),
    "quality_score": lambda s, d: PR.quality_score(I.raw(s, d)),
    "duplicate_rows": lambda s, d: QU.duplicate_rows(I.raw(s, d)),
    "negative_values": lambda s, d: QU.negative_values(I.raw(s, d)),
    "dq_score_100": lambda s, d: QU.dq_score_100(I.raw(s, d)),
    "quality_problems": lambda s, d: QU.quality_problems(I.raw(s, d)),
    # Cleaning
    "clean_table": lambda s, d: I.cleaned(s, d),
    "clean_sink": _clean_sink,
    "clean_funnel": lambda s, d: CL.clean_funnel(I.raw(s, d)),
    "clean_summary": lambda s, d: CL.clean_summary(I.raw(s, d)),
    # KPIs
    "sales_fallback": lambda s, d: KP.sales_fallback(I.raw(s, d)),
    "kpi_totals": lambda s, d: I.kpis_clean(s, d, "ca_total", "revenue_mean", "n_lines"),
    "monthly_revenue": lambda s, d: I.monthly(s, d),
    "top_countries": lambda s, d: I.countries(s, d),
    "distinct_customers": lambda s, d: I.kpis_clean(s, d, "n_customers"),
    "customer_sketches": _customer_sketches,
    "order_count": lambda s, d: I.kpis_clean(s, d, "n_orders"),
    "average_basket": lambda s, d: I.kpis_clean(s, d, "avg_basket"),
    "cancellation_rate": lambda s, d: I.kpis_raw(s, d, "cancellation_rate"),
    "cancelled_invoice_rate": lambda s, d: I.kpis_raw(s, d, "cancelled_invoice_rate"),
    "top_products": lambda s, d: I.products(s, d),
    "completeness": lambda s, d: I.kpis_raw(s, d, "completeness"),
    "return_rate": lambda s, d: I.kpis_raw(s, d, "return_rate"),
    "kpi_alerts": lambda s, d: I.alerts_raw(s, d),
    "kpi_insights": _insights,
    "kpi_insights_raw": _insights_raw,
    "kpi_document": _kpi_document,
    # Dashboard
    "month_over_month": lambda s, d: DB.month_over_month(I.monthly(s, d)),
    "report_period": lambda s, d: DB.report_period(I.monthly(s, d)),
    "lead_country": lambda s, d: DB.lead_country(I.countries(s, d)),
    "top5_product_share": lambda s, d: DB.top5_product_share(I.products(s, d)),
    "country_mix": lambda s, d: DB.country_mix(I.countries(s, d)),
    "chart_series": _chart_series,
    "chart_manifest": lambda s, d: DB.chart_manifest(_chart_series(s, d)),
    "monthly_scaled": lambda s, d: DB.monthly_scaled(I.monthly(s, d)),
    "recent_months": lambda s, d: DB.recent_months(I.monthly(s, d)),
    "headline_metrics": _headline_metrics,
    "dashboard_payload": _dashboard_payload,
    "metric_cards": _metric_cards,
    "alert_panel": lambda s, d: AL.alert_panel(I.alerts_raw(s, d)),
    # Report
    "report_kpis": lambda s, d: RP.report_kpis(I.kpis_clean(s, d)),
    "decision_tail": lambda s, d: RL.decision_tail(I.log(s, d), group="session"),
    "run_report": lambda s, d: RL.run_report(I.log(s, d)),
    # Run log
    "run_history": lambda s, d: RL.run_history(I.log(s, d)),
    "unauthorized_calls": lambda s, d: RL.unauthorized_calls(I.log(s, d), I.grants(s)),
    "allowed_calls": lambda s, d: RL.allowed_calls(I.log(s, d), I.grants(s)),
    "failure_triage": lambda s, d: RL.failure_triage(I.log(s, d), group="session"),
    "decisions_before_failures": lambda s, d: RL.decisions_before_failures(I.log(s, d)),
    "calls_in_lifetime": lambda s, d: RL.calls_in_lifetime(I.log(s, d)),
    "run_status": lambda s, d: RL.run_status(I.log(s, d)),
    "tool_calls": lambda s, d: RL.tool_calls(I.log(s, d)),
    "log_records": _log_lines,
    "live_run_status": _live_run_status,
    "payload_fields": _payload_fields,
    "artifact_list": _artifact_list,
}


def queries() -> dict[str, Query]:
    return {name: (lambda fn: (lambda s, d: to_output(fn(s, d))))(fn) for name, fn in QUERIES.items()}
